"""Time filters: inclusive ranges, hours of day, relative windows, continuation lines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions.events import with_time
from logharbor.operators.positions import CHUNK_BITS, at_positions, chunk_of, file_of, position_masks, with_position
from logharbor.runtime import join_spread, small_side


@dataclass(frozen=True)
class Bounds:
    """Time limits of a request. ISO text that cannot be read counts as absent."""

    start: str | None = None
    end: str | None = None
    hour_min: int | None = None
    hour_max: int | None = None

    @property
    def has_hours(self) -> bool:
        return self.hour_min is not None and self.hour_max is not None

    @property
    def has_dates(self) -> bool:
        return iso_bound(self.start) is not None or iso_bound(self.end) is not None


def iso_bound(text: str | None) -> str | None:
    """The bound in a form Spark casts to a timestamp, or None."""
    if not text:
        return None
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None).isoformat(sep=" ")
    except (TypeError, ValueError):
        return None


def in_dates(ts: str, start: str | None, end: str | None) -> str:
    limits = [(">=", iso_bound(start)), ("<=", iso_bound(end))]
    return " AND ".join(["true", *(f"{ts} {op} TIMESTAMP_NTZ '{at}'" for op, at in limits if at)])


def in_hours(ts: str, low: int, high: int) -> str:
    """Hour of day within the range; a range with low > high wraps midnight."""
    joined = "AND" if low <= high else "OR"
    return f"(hour({ts}) >= {int(low)} {joined} hour({ts}) <= {int(high)})"


def health_filter(lines: DataFrame, bounds: Bounds) -> DataFrame:
    """The filter of health reports: undated lines always stay, hours are not clamped."""
    ev = with_time(lines)
    cond = in_dates("ts", bounds.start, bounds.end)
    if bounds.has_hours:
        cond = f"{cond} AND {in_hours('ts', bounds.hour_min, bounds.hour_max)}"
    return ev if cond == "true" else ev.where(f"ts IS NULL OR ({cond})")


def keep_continuations(events: DataFrame, seed: str, reach: int = K.CONTINUATION_REACH,
                       chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Seed lines and the undated lines that follow them.

    An undated line stays if a line that stays lies at most ``reach`` lines
    above it; dated lines that are not seeds are dropped and do not interrupt.
    Runs of remaining lines at most ``reach`` apart form islands, and a line
    stays once its island has seen a seed.

    Seeds leave straight from the scan. Only positions of seeds and of undated
    lines are shuffled, by chunk, and one row per chunk tells the next chunk
    whether a kept line reaches into it. The undated lines that stay are then a
    set of positions, with which a second scan fetches them.
    """
    events = with_position(events)
    # plain conditions, so that time limits reach the scan of a landed table
    seeds = events.where(seed)

    marks = events.where(f"({seed}) OR ts IS NULL").selectExpr(
        "pos", f"coalesce({seed}, false) AS _seed", f"{chunk_of('pos', chunk_bits)} AS chunk"
    )
    in_chunk = "OVER (PARTITION BY chunk ORDER BY pos"
    so_far = f"{in_chunk} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    traced = marks.withColumn("_gap", F.expr(f"pos - lag(pos) {in_chunk})")).selectExpr(
        "*", f"max(IF(_seed, pos, NULL)) {so_far} AS _seed_at", f"max(IF(_gap > {int(reach)}, pos, NULL)) {so_far} AS _break_at"
    )
    alive = "(_seed_at IS NOT NULL AND coalesce(_break_at, -1L) <= _seed_at)"
    # no seed and no break so far: whatever reached into the chunk still holds
    opening = "(_seed_at IS NULL AND _break_at IS NULL)"

    in_file = f"OVER (PARTITION BY {file_of('first_pos')} ORDER BY chunk)"
    carry = (
        traced.groupBy("chunk")
        .agg(
            F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
            F.max("_seed_at").alias("_seed_at"), F.max("_break_at").alias("_break_at"),
        )
        .withColumn("linked", F.expr(f"coalesce(first_pos - lag(last_pos) {in_file} <= {int(reach)}, false)"))
        .withColumn("settled", F.expr(f"CASE WHEN {alive} THEN true WHEN NOT {opening} OR NOT linked THEN false END"))
        .withColumn("at_end", F.expr(f"last_value(settled) IGNORE NULLS {in_file}"))
        .selectExpr("chunk", f"coalesce(linked AND lag(at_end) {in_file}, false) AS _carried")
    )
    kept = traced.where("NOT _seed").join(carry, "chunk").where(f"{alive} OR ({opening} AND _carried)")
    undated = events.where(f"ts IS NULL AND NOT coalesce({seed}, false)")
    return seeds.unionByName(at_positions(undated, position_masks(kept), chunk_bits))


def date_range_filter(lines: DataFrame, start: str | None, end: str | None,
                      chunk_bits: int = CHUNK_BITS) -> DataFrame:
    ev = with_time(lines)
    seed = f"ts IS NOT NULL AND {in_dates('ts', start, end)}"
    return keep_continuations(ev, seed, chunk_bits=chunk_bits)


def hour_range_filter(lines: DataFrame, hour_min: int, hour_max: int, start: str | None = None,
                      end: str | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Hours clamped to 0..23, wrapping midnight if low > high, optionally dates too."""
    low, high = (max(0, min(23, h)) for h in (hour_min, hour_max))
    ev = with_time(lines)
    seed = f"ts IS NOT NULL AND {in_dates('ts', start, end)} AND {in_hours('ts', low, high)}"
    return keep_continuations(ev, seed, chunk_bits=chunk_bits)


def last_time_by_file(lines: DataFrame) -> DataFrame:
    """Time of the last dated line of each file, by line order, not the latest time."""
    ev = with_time(lines).where("ts IS NOT NULL")
    return ev.groupBy("file_ord").agg(F.max_by("ts", "line_no").alias("now"))


def relative_window_filter(lines: DataFrame, seconds: int, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Lines of the last ``seconds`` before each file's own last dated line.

    A file without any timestamp is kept whole.
    """
    ev = with_position(with_time(lines))
    now, few = small_side(last_time_by_file(lines))
    ends = now.selectExpr(
        f"CAST(min(now) - make_dt_interval(0, 0, 0, {int(seconds)}) AS STRING) AS low", "CAST(max(now) AS STRING) AS high"
    ).first()
    if ends.low is not None:
        # no file's window lies outside these limits, which the scan can use
        ev = ev.where(f"ts IS NULL OR (ts >= TIMESTAMP_NTZ '{ends.low}' AND ts <= TIMESTAMP_NTZ '{ends.high}')")
    timed = join_spread(ev, now, ["file_ord"], "pos", few, how="left")
    seed = f"now IS NULL OR ts BETWEEN now - make_dt_interval(0, 0, 0, {int(seconds)}) AND now"
    return keep_continuations(timed, seed, chunk_bits=chunk_bits).select(*ev.columns)


def apply_time_filter(lines: DataFrame, bounds: Bounds, window_seconds: int | None,
                      chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One filter only: an hour pair, else dates, else the prompt's window, else none."""
    if bounds.has_hours:
        return hour_range_filter(lines, bounds.hour_min, bounds.hour_max, bounds.start, bounds.end, chunk_bits)
    if bounds.has_dates:
        return date_range_filter(lines, bounds.start, bounds.end, chunk_bits)
    if window_seconds:
        return relative_window_filter(lines, window_seconds, chunk_bits)
    return with_position(lines)
