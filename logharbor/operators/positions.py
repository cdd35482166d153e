"""Global line positions and skew-free ordinals.

``pos`` packs (file_ord, line_no) into one long that sorts like the pair. Its
upper bits name a chunk of consecutive lines of one file. Every operation that
needs order works chunk by chunk and carries a tiny summary from chunk to
chunk, so a file of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.runtime import BROADCAST_ROWS, small_side

LINE_BITS = 40          # lines per file below 2**40, files below 2**23
CHUNK_BITS = 18         # 262,144 lines per chunk
GROUP_BITS = 12         # 4,096 chunks per second-level group

# Numbers that do not fit would sort wrongly without a word, so they stop the job.
POSITION = (
    f"(CASE WHEN file_ord >= {1 << (63 - LINE_BITS)} OR line_no >= {1 << LINE_BITS} "
    "THEN CAST(raise_error('file or line number too large for a position') AS BIGINT) "
    f"ELSE shiftleft(CAST(file_ord AS BIGINT), {LINE_BITS}) + line_no END)"
)


def with_position(lines: DataFrame) -> DataFrame:
    return lines if "pos" in lines.columns else lines.withColumn("pos", F.expr(POSITION))


def file_of(pos: str) -> str:
    return f"CAST(shiftright({pos}, {LINE_BITS}) AS INT)"


def line_of(pos: str) -> str:
    return f"({pos} & {(1 << LINE_BITS) - 1}L)"


def chunk_of(pos: str, chunk_bits: int = CHUNK_BITS) -> str:
    """Chunk number. Never null, so that joins on it add no null filters and
    equal exchanges below them stay equal and are run once."""
    return f"shiftright(coalesce({pos}, 0L), {chunk_bits})"


def chunk_starts(counts: DataFrame, per: str | None = None, group_bits: int = GROUP_BITS) -> DataFrame:
    """Rows before each chunk, from ``(chunk, rows[, per])``.

    Two levels: chunks are summed in groups, only the group totals are scanned
    in one window, and chunks are scanned inside their group in parallel. With
    ``per`` (constant within a group) the count starts anew for each value;
    ``total`` holds the number of all rows, or of all rows of that value.
    """
    outer = [per] if per else []
    grouped = counts.withColumn("grp", F.expr(f"shiftright(chunk, {group_bits})"))
    scope = f"PARTITION BY {per or '0'}"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    tops = grouped.groupBy(*outer, "grp").agg(F.sum("rows").alias("rows")).selectExpr(
        *outer, "grp",
        f"coalesce(sum(rows) OVER ({scope} ORDER BY grp {upto}), 0L) AS grp_start",
        f"sum(rows) OVER ({scope}) AS total",
    )
    inner_scope = ", ".join([*outer, "grp"])
    return (
        grouped.withColumn(
            "inner", F.expr(f"coalesce(sum(rows) OVER (PARTITION BY {inner_scope} ORDER BY chunk {upto}), 0L)")
        )
        .join(tops, [*outer, "grp"])
        .selectExpr("chunk", "grp_start + inner AS start", "rows", "total")
    )


RANK_IN_CHUNK = "CAST(row_number() OVER (PARTITION BY chunk ORDER BY pos) - 1 AS BIGINT)"


def with_ordinal(rows: DataFrame, out: str = "ordinal", per: str | None = None,
                 chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Add the 0-based rank by ``pos``, over all rows or anew per file.

    Ranks within a chunk and the chunk's start are joined on the chunk, by
    which both sides are already partitioned.
    """
    keyed = rows.withColumn("chunk", F.expr(chunk_of("pos", chunk_bits)))
    counts = keyed.groupBy(*([per] if per else []), "chunk").agg(F.count("*").alias("rows"))
    starts = chunk_starts(counts, per).select("chunk", "start")
    return (
        keyed.withColumn("_rank", F.expr(RANK_IN_CHUNK))
        .join(starts, "chunk")
        .withColumn(out, F.expr("start + _rank"))
        .drop("chunk", "start", "_rank")
    )


def head_limit(rows: DataFrame, n: int, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row ``limit_pos``: no row among the first ``n`` by ``pos`` lies at or beyond it.

    Each non-empty chunk holds a row, so the first ``n`` chunks are enough.
    """
    per_chunk = (
        rows.groupBy(F.expr(chunk_of("pos", chunk_bits)).alias("chunk"))
        .agg(F.count("*").alias("rows"))
        .orderBy("chunk")
        .limit(n)
    )
    before = "sum(rows) OVER (PARTITION BY 0 ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    needed = per_chunk.withColumn("before", F.expr(f"coalesce({before}, 0L)")).where(f"before < {int(n)}")
    return needed.agg(F.expr(f"shiftleft(max(chunk) + 1, {chunk_bits})").alias("limit_pos"))


def first_rows(rows: DataFrame, n: int, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The first ``n`` rows by ``pos``.

    A plain ordered limit sends n rows of every task to one; counting per chunk
    first leaves at most n rows and one chunk to sort.
    """
    bound = head_limit(rows, n, chunk_bits).scalar()
    return rows.where(F.col("pos") < bound).orderBy("pos").limit(n)


def position_masks(rows: DataFrame, bound: int | None = None) -> tuple[DataFrame, bool]:
    """``(word, mask)`` of the rows' ``pos``: 64 positions a row, and whether they are few enough to broadcast.

    A set of positions for filtering a scan: 16 bytes for 64 neighbouring lines. Its
    size is measured unless the caller knows a ``bound`` of the rows.
    """
    masks = rows.groupBy(F.expr("shiftright(pos, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(pos & 63 AS INT)))").alias("mask"))
    if bound is not None and bound <= BROADCAST_ROWS:
        return F.broadcast(masks), True
    return small_side(masks)


def at_positions(rows: DataFrame, masks: tuple[DataFrame, bool], chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Rows whose ``pos`` the masks hold.

    Few masks are broadcast, so no row is shuffled. Of many, the chunks that hold any
    position filter the scan first, and only rows of those meet the masks by word.
    """
    words, few = masks
    if not few:
        chunks, _ = small_side(words.select(F.expr(f"shiftright(word, {chunk_bits} - 6)").alias("_chunk")).distinct()
                               if chunk_bits >= 6 else words.selectExpr("word AS _chunk").distinct())
        own = F.expr(f"shiftright(pos, {max(chunk_bits, 6)})")
        rows = rows.join(chunks, own == F.col("_chunk"), "left_semi")
    met = rows.join(words, F.expr("shiftright(pos, 6)") == F.col("word"))
    return met.where("getbit(mask, CAST(pos & 63 AS INT)) = 1").select(*rows.columns)
