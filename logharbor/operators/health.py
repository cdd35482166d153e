"""How bad is it: totals, tag counts, error-rate windows, error lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions.events import TAG_NAMES, bucket_start, error_rows, mask_has, with_events
from logharbor.functions.numbers import ratio, round_exact
from logharbor.operators.positions import with_position
from logharbor.operators.timefilter import Bounds, health_filter


def bucket_summary(lines: DataFrame, bucket_minutes: int = K.BUCKET_MINUTES,
                   bounds: Bounds = Bounds()) -> DataFrame:
    """One row per time bucket, undated lines under a null bucket.

    A single scan with map-side aggregation feeds totals, tag counts and
    windows, which are all sums over this table. Its size depends on the time
    covered, not on the number of lines.
    """
    ev = with_position(health_filter(with_events(lines), bounds))
    per_tag = []
    for tag in TAG_NAMES:
        hit = mask_has("tag_mask", tag)
        per_tag += [F.expr(f"count_if{hit} AS n_{tag}"), F.expr(f"min(IF({hit}, pos, NULL)) AS first_{tag}")]
    return (
        ev.selectExpr(f"{bucket_start('ts', bucket_minutes)} AS window_start", "tag_mask", "pos")
        .groupBy("window_start")
        .agg(F.count("*").alias("total"), F.expr("count_if(tag_mask <> 0)").alias("errors"), *per_tag)
    )


def totals(summary: DataFrame) -> DataFrame:
    """``total_lines, error_lines, error_rate``; one row, also for no lines."""
    sums = summary.agg(
        F.expr("coalesce(sum(total), 0L) AS total_lines"), F.expr("coalesce(sum(errors), 0L) AS error_lines")
    )
    return sums.withColumn("error_rate", F.expr(round_exact(ratio("error_lines", "total_lines"), 4)))


def pattern_counts(summary: DataFrame) -> DataFrame:
    """``pattern, cnt`` with ``rank``: by count, ties by the first line, then tag order."""
    sums = summary.agg(*[
        F.expr(sql) for t in TAG_NAMES for sql in (f"sum(n_{t}) AS n_{t}", f"min(first_{t}) AS first_{t}")
    ])
    rows = ", ".join(
        f"named_struct('pattern', '{t}', 'cnt', n_{t}, 'first_pos', first_{t}, 'tag_no', {i})"
        for i, t in enumerate(TAG_NAMES)
    )
    # one row per tag at most
    rank = "row_number() OVER (PARTITION BY 0 ORDER BY cnt DESC, first_pos, tag_no) AS rank"
    return sums.selectExpr(f"inline(array({rows}))").where("cnt > 0").selectExpr("pattern", "cnt", rank)


def top_patterns(counts: DataFrame, n: int = K.TOP_PATTERNS) -> DataFrame:
    return counts.where(F.col("rank") <= n)


def pattern_share(counts: DataFrame) -> DataFrame:
    """Add ``percent`` of all tag hits, one place, exact ties upwards."""
    share = counts.withColumn("_share", F.expr("cnt / sum(cnt) OVER (PARTITION BY 0) * 100D"))
    return share.withColumn("percent", F.expr(round_exact("_share", 1, ties="up"))).drop("_share")


def error_windows(summary: DataFrame, bucket_minutes: int = K.BUCKET_MINUTES) -> DataFrame:
    """``window_start, window_minutes, total, errors, error_rate`` of dated lines."""
    return summary.where("window_start IS NOT NULL").selectExpr(
        "window_start", f"{int(bucket_minutes)} AS window_minutes", "total", "errors",
        f"{round_exact(ratio('errors', 'total'), 4)} AS error_rate",
    )


def high_error_windows(summary: DataFrame, bucket_minutes: int = K.BUCKET_MINUTES,
                       threshold: float = K.HIGH_ERROR_THRESHOLD) -> DataFrame:
    """Windows whose unrounded error rate reaches the threshold, by start."""
    high = summary.where(f"{ratio('errors', 'total')} >= {float(threshold)!r}D")
    return error_windows(high, bucket_minutes).orderBy("window_start")


def error_lines(lines: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """All lines with any tag, as rows. Order by ``pos``, or sample, afterwards."""
    ev = with_position(health_filter(lines, bounds))
    return ev.where(error_rows(ev))


def lines_per_file(lines: DataFrame) -> DataFrame:
    """Unfiltered line count per file."""
    return lines.groupBy("file").agg(F.count("*").alias("lines"))
