"""Health, search and continuation lines on a stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions.events import TAG_NAMES, bucket_start, mask_has, mask_names, with_events, with_time
from logharbor.functions.prompts import Prompt
from logharbor.operators.context import add_context
from logharbor.operators.positions import CHUNK_BITS, POSITION, with_ordinal, with_position
from logharbor.operators.search import is_match
from logharbor.operators.timefilter import keep_continuations
from logharbor.runtime import cut_lineage, new_folder


def live_windows(stream: DataFrame, bucket_minutes: int = K.BUCKET_MINUTES, delay: str = "1 hour") -> DataFrame:
    """Running ``window_start, total, errors`` of dated lines.

    The bucket is a zoned timestamp here, as a watermark needs one; with a UTC
    session it shows the same clock time. Rows later than the watermark are
    dropped in append mode; the batch report has no such limit.
    """
    ev = with_events(stream).where("ts IS NOT NULL")
    return (
        ev.selectExpr(f"CAST({bucket_start('ts', bucket_minutes)} AS TIMESTAMP) AS window_start", "tag_mask")
        .withWatermark("window_start", delay)
        .groupBy("window_start")
        .agg(F.count("*").alias("total"), F.expr("count_if(tag_mask <> 0)").alias("errors"))
    )


def live_totals(stream: DataFrame) -> DataFrame:
    """Running line, error and tag counts, one row."""
    per_tag = [F.expr(f"count_if({mask_has('tag_mask', t)}) AS {t}") for t in TAG_NAMES]
    return with_events(stream).groupBy().agg(
        F.count("*").alias("total_lines"), F.expr("count_if(tag_mask <> 0)").alias("error_lines"), *per_tag
    )


def live_pattern_counts(stream: DataFrame) -> DataFrame:
    """Running ``pattern, cnt``."""
    hits = with_events(stream).selectExpr(f"explode({mask_names('tag_mask')}) AS pattern")
    return hits.groupBy("pattern").agg(F.count("*").alias("cnt"))


def live_matches(stream: DataFrame, prompt: Prompt) -> DataFrame:
    """Lines matching the prompt or any tag, as they arrive."""
    return stream.where(is_match(stream, prompt))


def _run(writer, catch_up: bool) -> None:
    """One batch of what is there now, or batch after batch until nothing is left, for sources with a budget."""
    if not catch_up:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def run_to_table(result: DataFrame, mode: str, checkpoint: str | None = None, path: str | None = None,
                 catch_up: bool = False) -> DataFrame:
    """Process what is there now and return the result table.

    With ``catch_up`` batches follow one another until a source with a byte budget
    has no more. In complete mode each batch replaces the table; in append mode every batch
    is written under its own number, so a repeated batch replaces itself.
    """
    if mode not in ("complete", "append"):
        raise ValueError("mode must be complete or append")
    spark = result.sparkSession
    path = path or new_folder(spark, "stream-out")

    def write(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    _run(result.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint or new_folder(spark, "stream-state")), catch_up)
    found = spark.read.schema(result.schema).parquet(path)
    return found.select(*result.columns)


def _numbered(batch: DataFrame, before: DataFrame, chunk_bits: int) -> tuple[DataFrame, str]:
    """The batch with ``line_no`` counted on from ``before(file_ord, next_line, ...)``, and when a file goes on.

    A file has one range per batch. A range from byte 0 is a file begun anew, any
    other goes on where the last one ended.
    """
    begins = batch.groupBy("file_ord").agg(F.min("offset").alias("_begin")).join(before, "file_ord", "left")
    same = "_begin > 0 AND next_line IS NOT NULL"
    # in-batch order is the distance from the range's begin, so that only a batch is limited to 2**40 bytes a file
    keyed = batch.join(begins, "file_ord").withColumn("pos", F.expr(POSITION.replace("line_no", "(offset - _begin)")))
    keyed = with_ordinal(keyed, "_nth", per="file_ord", chunk_bits=chunk_bits + 7).drop("pos")
    return keyed.withColumn("line_no", F.expr(f"_nth + IF({same}, next_line, 0L)")).drop("_nth"), same


class LiveTimeFilter:
    """``foreachBatch`` writer: time filter with continuation lines over batches.

    Input is the tail stream. Each batch numbers its lines after those of
    earlier batches and keeps undated lines near the last kept line, which may
    lie in an earlier batch. What passes from batch to batch is one row per
    file, stored under the batch number: a repeated batch starts from the same
    row and replaces its own output. A rotated file starts at line 0 again.
    """

    STATE = "file_ord int, generation string, next_line bigint, last_kept bigint"

    def __init__(self, spark: SparkSession, seed: str, out: str, state: str,
                 chunk_bits: int = CHUNK_BITS) -> None:
        self.seed, self.out, self.state, self.chunk_bits = seed, out, state, chunk_bits
        self.spark = spark

    def _before(self, number: int) -> DataFrame:
        if number == 0:
            return self.spark.createDataFrame([], self.STATE)
        return self.spark.read.schema(self.STATE).parquet(f"{self.state}/{number - 1}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = self._before(number)
        keyed, same = _numbered(batch, before.drop("generation"), self.chunk_bits)
        lines = cut_lineage(
            keyed.withColumn("_last", F.expr(f"IF({same}, last_kept, NULL)")).drop("_begin", "next_line", "last_kept")
        )
        ev = with_position(with_time(lines)).withColumn("_old", F.lit(False))
        # the last kept line of an earlier batch takes part as a seed
        earlier = (
            ev.where("_last IS NOT NULL").dropDuplicates(["file_ord"])
            .withColumn("line_no", F.col("_last")).withColumn("pos", F.expr(POSITION))
            .withColumn("_old", F.lit(True)).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
        )
        kept = cut_lineage(
            keep_continuations(ev.unionByName(earlier), f"_old OR (ts IS NOT NULL AND ({self.seed}))",
                               chunk_bits=self.chunk_bits).where("NOT _old")
        )
        kept.select("file", "file_ord", "generation", "line_no", "line", "ts").write.mode("overwrite").parquet(
            f"{self.out}/batch={number}"
        )
        ends = lines.groupBy("file_ord").agg(
            F.first("generation").alias("generation"), F.expr("max(line_no) + 1 AS next_line"), F.max("_last").alias("_last")
        )
        last = kept.groupBy("file_ord").agg(F.max("line_no").alias("_kept"))
        now = ends.join(last, "file_ord", "left").selectExpr(
            "file_ord", "generation", "next_line", "coalesce(_kept, _last) AS last_kept"
        )
        idle = before.join(now, "file_ord", "left_anti")
        now.unionByName(idle).write.mode("overwrite").parquet(f"{self.state}/{number}")


def run_live_filter(stream: DataFrame, seed: str, out: str, state: str, checkpoint: str,
                    chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Run the live time filter over what is there now; returns all lines kept so far."""
    spark = stream.sparkSession
    _run(stream.writeStream.foreachBatch(LiveTimeFilter(spark, seed, out, state, chunk_bits)).option("checkpointLocation", checkpoint), False)
    return spark.read.parquet(out).drop("batch")



class LiveContext:
    """``foreachBatch`` writer: matches with the lines around them, whatever batches those come in.

    Input is the tail stream. From batch to batch pass, per file, its next line number
    and its last 2c lines, stored under the batch number: a repeated batch starts from the
    same rows and replaces its own output. Each batch writes the matches whose c
    following lines have become known; ``waiting`` gives those of the last c lines.
    When a file is begun anew, what waits of its former lines is written as it is.
    """

    ENDS = "file_ord int, next_line bigint"
    LAST = "file string, file_ord int, line_no bigint, line string"

    def __init__(self, spark: SparkSession, prompt: Prompt, context_lines: int, out: str, state: str, chunk_bits: int = CHUNK_BITS) -> None:
        self.spark, self.prompt, self.c = spark, prompt, max(int(context_lines), 0)
        self.out, self.state, self.chunk_bits = out, state, chunk_bits

    def _before(self, number: int) -> tuple[DataFrame, DataFrame]:
        if number == 0:
            return self.spark.createDataFrame([], self.ENDS), self.spark.createDataFrame([], self.LAST)
        at = f"{self.state}/{number - 1}"
        return self.spark.read.schema(self.ENDS).parquet(f"{at}/ends"), self.spark.read.schema(self.LAST).parquet(f"{at}/last")

    def _found(self, lines: DataFrame, ends: DataFrame, wanted: str) -> DataFrame:
        """Matches among ``lines`` with context, of the line numbers ``wanted`` says by the file's ends."""
        lines = with_position(lines)
        hits = lines.where(is_match(lines, self.prompt)).join(ends, "file_ord").where(wanted)
        return add_context(hits.select(*lines.columns), lines, self.c).select("file", "file_ord", "line_no", "line", "context")

    def waiting(self, number: int) -> DataFrame:
        """Matches that still wait for lines below them after batch ``number``."""
        ends, last = self._before(number + 1)
        return self._found(last, ends, f"line_no >= next_line - {self.c}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        c = self.c
        ends, last = self._before(number)
        keyed, same = _numbered(batch, ends, self.chunk_bits)
        lines = cut_lineage(keyed.select("file", "file_ord", "line_no", "line", F.expr(same).alias("_same"), "next_line"))
        # Per file of the batch: whether it goes on, its lines before (0 if it begins) and now.
        files = cut_lineage(lines.groupBy("file_ord").agg(
            F.first("_same").alias("_same"), F.expr("first(IF(_same, next_line, 0L)) AS _then"), F.expr("max(line_no) + 1 AS next_line")))
        going_on, anew = files.where("_same"), files.where("NOT _same")
        around = cut_lineage(lines.drop("_same", "next_line").unionByName(last.join(going_on.select("file_ord"), "file_ord", "left_semi")))
        known = self._found(around, files, f"line_no >= _then - {c} AND line_no < next_line - {c}")
        replaced = last.join(anew.select("file_ord"), "file_ord", "left_semi")
        left = self._found(replaced, ends, f"line_no >= next_line - {c}")
        known.unionByName(left).write.mode("overwrite").parquet(f"{self.out}/batch={number}")

        idle = last.join(files, "file_ord", "left_anti")
        kept = around.join(files.select("file_ord", "next_line"), "file_ord").where(f"line_no >= next_line - {2 * c}")
        at = f"{self.state}/{number}"
        kept.select("file", "file_ord", "line_no", "line").unionByName(idle).write.mode("overwrite").parquet(f"{at}/last")
        files.select("file_ord", "next_line").unionByName(ends.join(files, "file_ord", "left_anti")).write.mode("overwrite").parquet(f"{at}/ends")


def run_live_context(stream: DataFrame, prompt: Prompt, context_lines: int, out: str, state: str, checkpoint: str,
                     catch_up: bool = False, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Run the live search over what is there now; all matches so far, those at a file's end with the lines there are."""
    writer = LiveContext(stream.sparkSession, prompt, context_lines, out, state, chunk_bits)
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        writer(batch, number)
        batches.append(number)

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), catch_up)
    spark = stream.sparkSession
    last = batches[-1] if batches else _last_batch(spark, state)
    found = spark.read.parquet(out).drop("batch")
    return found.unionByName(writer.waiting(last)) if last is not None else found


def _last_batch(spark: SparkSession, state: str) -> int | None:
    """Number of the last batch whose state is complete."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "_SUCCESS").option("recursiveFileLookup", "true").load(state)
    ends = found.select(F.regexp_extract("path", "/([0-9]+)/ends/_SUCCESS$", 1).alias("n")).where("n <> ''")
    return ends.agg(F.max(F.col("n").cast("int"))).first()[0]
