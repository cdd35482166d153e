"""Log lines, prompts and document lines derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators.positions import with_ordinal, with_position
from logharbor.runtime import new_folder
from logharbor.sources.logfiles import land

_landed: dict[tuple[str, str], str] = {}
_scan_parts: dict[tuple[str, str], int] = {}

FILE_SQL = "concat('app-', CAST(user_id % 4 AS STRING), '.log')"

# Text of one log line per event, the same expression for Spark and for the check queries.
LINE_SQL = """concat(
  CASE WHEN event_id % 10 = 3 THEN '    '
       WHEN event_id % 3 = 0 THEN concat(substr(CAST(ts AS STRING), 1, 19), ' ')
       WHEN event_id % 3 = 1 THEN concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), ' ')
       ELSE concat(replace(substr(CAST(ts AS STRING), 1, 19), '-', '/'), ' ') END,
  CASE WHEN event_id % 10 = 3 THEN ''
       WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL '
       WHEN event_type = 'error' THEN 'ERROR '
       WHEN event_type = 'purchase' AND value >= 100 THEN 'WARNING '
       ELSE 'INFO ' END,
  CASE WHEN event_id % 10 = 3 THEN concat('at com.example.', event_type, '.Handler.run(Handler.java:', CAST(user_id AS STRING), ')')
       WHEN event_type = 'error' AND event_id % 5 = 0 THEN concat('[payment-service] Request timed out after ', CAST(user_id AS STRING), 's')
       WHEN event_type = 'error' AND event_id % 5 = 1 THEN '[auth-gateway] HTTP 503 from upstream: service unavailable'
       WHEN event_type = 'error' AND event_id % 5 = 2 THEN '[order-processor] Exception: SocketTimeoutException: read failed'
       WHEN event_type = 'error' AND event_id % 5 = 3 THEN '[cache-manager] No space left on device, disk quota exceeded'
       WHEN event_type = 'error' THEN concat('[user-api] Database connection refused for user ', CAST(user_id AS STRING))
       ELSE concat('[user-api] ', event_type, ' completed in ', CAST(user_id AS STRING), 'ms') END)"""

# One prompt per event, in the forms people type.
PROMPT_SQL = """CASE event_id % 8
  WHEN 0 THEN concat('database ', event_type, ' problems from the last ', CAST(user_id AS STRING), ' minutes')
  WHEN 1 THEN concat('timeout past ', CAST(user_id AS STRING), 'h')
  WHEN 2 THEN 'what are the main error categories'
  WHEN 3 THEN concat('connection refused since ', CAST(user_id AS STRING), 's ago')
  WHEN 4 THEN concat('show ', event_type, ' failures for the last ', CAST(user_id AS STRING), ' Days')
  WHEN 5 THEN concat('JWT-token v', CAST(user_id AS STRING), '.2 expired for user_', CAST(user_id AS STRING))
  WHEN 6 THEN event_type
  ELSE concat('errors within ', CAST(user_id % 3 AS STRING), ' hr') END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return _spread(spark, f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, path: str) -> DataFrame:
    """Parquet read with at least one partition per core.

    A file with one row group is read by one task whatever its size. Only a
    scan with fewer partitions than cores is spread; a large one never is.
    """
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    key = (spark.sparkContext.applicationId, path)
    if key not in _scan_parts:
        _scan_parts[key] = rows.rdd.getNumPartitions()
    return rows.repartition(cores) if _scan_parts[key] < cores else rows


def lines_of(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as lines; ``line_no`` is the event number, which leaves gaps.

    Exploding a one-element array keeps the optimizer from repeating the long
    text expression inside every condition on the line.
    """
    return events.selectExpr(
        f"{FILE_SQL} AS file", "CAST(user_id % 4 AS INT) AS file_ord", "event_id AS line_no",
        f"explode(array({LINE_SQL})) AS line",
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in event order, without dense numbers: enough for counts and windows."""
    return lines_of(table(spark, sf_dir, "events"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines numbered from 0 within each file."""
    keyed = with_position(event_lines(spark, sf_dir))
    numbered = with_ordinal(keyed, "number", per="file_ord")
    return numbered.select("file", "file_ord", F.col("number").alias("line_no"), "line")


def landed_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the numbered lines, landed once per application with time and tags."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        path = new_folder(spark, "lines")
        land(numbered_lines(spark, sf_dir), path)
        _landed[key] = path
    return _landed[key]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed lines."""
    return _spread(spark, landed_path(spark, sf_dir))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("prompt_id"), F.expr(PROMPT_SQL).alias("prompt")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document text split at line feeds; ``doc_id`` is the file."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with id 0, used as a query."""
    return [float(x) for x in vectors(spark, sf_dir).where(F.col("pos") == 0).first().embedding]
