"""Distinct error texts and their frequent words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions.events import with_time
from logharbor.functions.text import error_signature, label_tokens
from logharbor.operators.health import error_lines
from logharbor.operators.timefilter import Bounds


def signature_rollup(lines: DataFrame, bounds: Bounds = Bounds(), length: int | None = None) -> DataFrame:
    """``signature, cnt, first_seen, last_seen`` of all error lines."""
    ev = with_time(error_lines(lines, bounds))
    return (
        ev.selectExpr(f"{error_signature('line', length)} AS signature", "ts")
        .groupBy("signature")
        .agg(F.count("*").alias("cnt"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    )


def top_keywords(rows: DataFrame, group: str, n: int = K.LABEL_KEYWORDS, text: str = "line") -> DataFrame:
    """``group, rank, keyword, cnt``: tokens in most lines, ties by first encounter.

    Rows need ``pos``. Tokens are counted with map-side aggregation, and the
    rank filter is applied per task before the exchange, so a group with an
    unbounded vocabulary never meets in one task.
    """
    words = rows.selectExpr(group, "pos", f"posexplode({label_tokens(text)}) AS (_at, keyword)")
    # one decimal for (pos, _at): a fixed-width minimum keeps the aggregation hash-based
    counted = words.groupBy(group, "keyword").agg(
        F.count("*").alias("cnt"), F.expr("min(CAST(pos AS DECIMAL(38, 0)) * 1000000000 + _at)").alias("_first")
    )
    order = Window.partitionBy(group).orderBy(F.desc("cnt"), "_first")
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(group, "rank", "keyword", "cnt")
    )
