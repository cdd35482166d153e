"""Text log files as numbered lines, present and missing files, landed tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor.functions.events import with_events
from logharbor.operators.positions import with_position
from logharbor.runtime import BROADCAST_ROWS, cut_lineage, new_folder

ASKED_AT_ONCE = 32
# Folder in a landed table, hidden from its readers, that tells which positions each file holds.
ZONES = "_zones"


def split_paths(text: str) -> list[str]:
    """Paths from a comma-separated setting."""
    return [p.strip() for p in text.split(",") if p.strip()]


def requested_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, file_ord`` as asked for; blanks dropped, an empty list is an error."""
    names = [p.strip() for p in paths if p and p.strip()]
    if not names:
        raise ValueError("no log files given")
    return spark.createDataFrame(list(zip(names, range(len(names)))), "file string, file_ord int")


def _listing(spark: SparkSession, paths: list[str]) -> list[str]:
    """URIs of the files at or below the paths, empty ones too. Only names reach the driver."""
    try:
        return spark.read.text(paths).inputFiles()
    except AnalysisException:
        if len(paths) == 1:
            return []
        return [uri for path in paths for uri in _listing(spark, [path])]


def _plain(path: str) -> str:
    """A path or URI without the local scheme and percent codes, for comparison."""
    # never null, so that joins on it push no null test down to every line
    decoded = f"IF({path} RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*:', try_url_decode(replace({path}, '+', '%2B')), {path})"
    return f"coalesce(regexp_replace(regexp_replace({decoded}, '^file:/*', '/'), '(?<![:/])/+', '/'), '')"


def _file_uris(spark: SparkSession, names: list[str]) -> list[tuple[str, str]]:
    """``(name, URI)`` of the names that are files, asked of the file system as they are."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def uri(name: str) -> str | None:
        at = jvm.org.apache.hadoop.fs.Path(name)
        system = at.getFileSystem(conf)
        return system.makeQualified(at).toUri().toString() if system.isFile(at) else None

    with ThreadPoolExecutor(ASKED_AT_ONCE) as pool:
        found = [(name, at) for name, at in zip(names, pool.map(uri, names)) if at]
    hidden = [name for name, _ in found if name.rsplit("/", 1)[-1].startswith(("_", "."))]
    if hidden:
        raise ValueError(f"Spark reads no files whose names begin with _ or a dot: {hidden[:5]}")
    return found


def present_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, file_ord, path`` of the requested paths that are files.

    Directories and globs are not files; expand them with ``expand`` first. A
    name may hold glob characters. Present files that Spark's readers hide
    (names beginning with ``_`` or a dot) are an error, not missing.
    """
    asked = requested_files(spark, paths)
    names = list(dict.fromkeys(p.strip() for p in paths if p and p.strip()))
    found = spark.createDataFrame(_file_uris(spark, names), "file string, uri string")
    return asked.join(found, "file").selectExpr("file", "file_ord", f"{_plain('uri')} AS path")


def missing_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Requested paths that do not exist or are not files."""
    asked = requested_files(spark, paths)
    return asked.join(present_files(spark, paths).select("file"), "file", "left_anti").orderBy("file_ord")


def missing_names(requested: DataFrame, folder: str) -> DataFrame:
    """Rows of ``requested(file, ...)`` that are no files below ``folder``: any number of names.

    The folder is listed by Spark's binary reader, of whose rows only paths are read;
    names and paths meet in a join, none on the driver. Hidden names (``_x``, ``.x``) count as missing.
    """
    spark = requested.sparkSession
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # These paths come without percent codes.
    present = found.select(F.expr("regexp_replace(path, '^file:/*', '/')").alias("_path"))
    return requested.join(present, F.expr(_plain("file")) == F.col("_path"), "left_anti")


def expand(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """File paths below directories and globs, ordered by entry and path."""
    out: list[str] = []
    for path in paths:
        found = spark.createDataFrame([(u,) for u in _listing(spark, [path])], "uri string")
        out += sorted(r.path for r in found.selectExpr(f"{_plain('uri')} AS path").collect())
    return out


def clean_text(value: str) -> str:
    """Text without the bytes that are not UTF-8."""
    return f"IF(is_valid_utf8({value}), {value}, replace(make_valid_utf8({value}), '\\uFFFD', ''))"


def _scan(spark: SparkSession, names: list[str]) -> DataFrame:
    # Row ids make this projection a barrier: later filters on the line do not
    # repeat its clean-up inside every condition.
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", name) for name in names]
    return spark.read.text(literal).selectExpr(
        "_metadata.file_path AS uri", "_metadata.file_block_start AS block",
        "_metadata.file_block_start + _metadata.file_block_length AS _end", "_metadata.file_size AS _size",
        "monotonically_increasing_id() AS _row", f"{clean_text('value')} AS line",
    )


@dataclass(frozen=True)
class LogSet:
    """Requested files: their lines, line counts (0 for empty or missing ones) and what is missing."""

    lines: DataFrame
    line_counts: DataFrame
    missing: DataFrame


def open_logs(spark: SparkSession, paths: Sequence[str]) -> LogSet:
    """``lines(file, file_ord, line_no, line)`` numbered from 0, ``line_counts(file, file_ord, lines)``, ``missing``.

    Files are read in parallel splits. A first pass counts lines per split; a
    running sum over that small table gives each split's first line number, and
    a line's number is that plus its distance from the split's first row. No
    line is shuffled or sorted. If the second pass should split files in
    another way, the job fails rather than misnumber a line. Line counts come
    from the same small table. Files may grow meanwhile: the lines are those that
    began before the length of the first pass, where the very last one may have
    become longer, however many splits it fills.
    """
    asked = requested_files(spark, paths)
    files = cut_lineage(present_files(spark, paths))
    missing = asked.join(files.select("file"), "file", "left_anti").orderBy("file_ord")
    names = [r.file for r in files.groupBy("path").agg(F.min("file").alias("file")).orderBy("path").collect()]
    if not names:
        lines = spark.createDataFrame([], "file string, file_ord int, line_no bigint, line string")
        return LogSet(lines, asked.withColumn("lines", F.lit(0).cast("bigint")), missing)
    scan = _scan(spark, names)
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(
        scan.groupBy("uri", "block").agg(F.min("_row").alias("first_row"), F.count("*").alias("rows"), F.max("_end").alias("end"),
                                         F.max("_size").alias("size"))
        .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn("path", F.expr(_plain("uri")))
        .join(files, "path").drop("path")
    )
    few = blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Of each file: its length in the first pass, and the last split in which a line began.
    ends = blocks.groupBy("uri").agg(F.max("size").alias("_was"), F.max("block").alias("_last"))
    at = F.col("_row") - F.col("first_row")
    same = (at >= 0) & (at < F.col("rows")) & (F.col("_end") >= F.col("end"))
    checked = F.when(same, F.col("start") + at).otherwise(
        F.raise_error(F.lit("file splits changed between passes; set spark.sql.files.minPartitionNum")).cast("bigint")
    )
    # What was written after the first pass: lines beyond the count of the split where the file ended, or of later splits.
    beyond = F.col("first_row").isNull() & (F.col("block") > F.col("_last")) | (at >= F.col("rows")) & (F.col("_end") >= F.col("end"))
    later = F.col("_was").isNull() | (F.col("_end") >= F.col("_was")) & F.coalesce(beyond, F.lit(False))
    lines = (
        scan.join(F.broadcast(blocks.drop("size")) if few else blocks.drop("size"), ["uri", "block"], "left")
        .join(F.broadcast(ends) if few else ends, "uri", "left")
        .where(~later)
        .select("file", "file_ord", checked.alias("line_no"), "line")
    )
    counted = blocks.groupBy("file_ord").agg(F.sum("rows").alias("lines"))
    counts = asked.join(counted, "file_ord", "left").na.fill(0, ["lines"]).select("file", "file_ord", "lines")
    return LogSet(lines, counts, missing)


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The lines of ``open_logs``."""
    return open_logs(spark, paths).lines


def text_table(rows: DataFrame, text: str, file: str, position: str) -> DataFrame:
    """Any table with a text column as lines: ``file`` names the source, ``position`` orders it.

    ``position`` must be a 0-based line number without gaps where context or
    continuation lines are wanted; any increasing integer does for the rest.
    Sources are numbered by name; positions have room for 2**23 of them.
    """
    named = rows.select(F.col(file).alias("file"), F.col(position).cast("bigint").alias("line_no"), F.col(text).alias("line"))
    order = Window.partitionBy(F.lit(0)).orderBy("file")
    ords = named.select("file").distinct().withColumn("file_ord", (F.row_number().over(order) - 1).cast("int"))
    ords = cut_lineage(ords)
    few = ords.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return named.join(F.broadcast(ords) if few else ords, "file").select("file", "file_ord", "line_no", "line")


def land(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Write lines once as Parquet with their position, parsed time and tags.

    Reports on the landed table read columns instead of parsing text again.
    Lines of a scan arrive in file order, so nothing is shuffled, and row groups
    carry narrow position and time ranges that filters can skip. One row per
    written file goes to the table's zones.
    """
    spark = lines.sparkSession
    path = path or new_folder(spark, "lines")
    with_position(with_events(lines)).write.mode("errorifexists").parquet(path)
    landed = spark.read.parquet(path)
    ends = landed.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("rows"))
    ends.write.parquet(f"{path}/{ZONES}")
    return landed


def landed_zones(spark: SparkSession, path: str) -> DataFrame:
    """``path, first_pos, last_pos, rows`` of each file of a landed table that holds lines."""
    return spark.read.parquet(f"{path}/{ZONES}")
