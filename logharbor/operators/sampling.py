"""Even sampling: k rows spread over n by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.operators.positions import CHUNK_BITS, RANK_IN_CHUNK, chunk_of, chunk_starts
from logharbor.runtime import BROADCAST_ROWS


def picked_ordinal(i: str, n: str, k: str) -> str:
    """Ordinal of the i-th of k picks among n rows."""
    return f"CAST(floor({i} * (CAST({n} AS DOUBLE) / CAST({k} AS DOUBLE))) AS BIGINT)"


def even_positions(rows: DataFrame, k: int, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``(pos, pick)`` of the sampled rows; all rows when there are at most k.

    Only positions are shuffled, once: counts and ranks use the same exchange.
    Each chunk works out which picks fall into it.
    """
    keyed = rows.select("pos", F.expr(chunk_of("pos", chunk_bits)).alias("chunk")).repartition("chunk")
    starts = chunk_starts(keyed.groupBy("chunk").agg(F.count("pos").alias("rows")))
    around = (
        "explode(sequence(greatest(0L, CAST(floor(start / step) - 1 AS BIGINT)),"
        " least(size - 1, CAST(ceil((start + rows) / step) + 1 AS BIGINT)))) AS pick"
    )
    wanted = (
        starts.withColumn("size", F.expr(f"least(total, {int(k)}L)"))
        .withColumn("step", F.expr("CAST(total AS DOUBLE) / CAST(size AS DOUBLE)"))
        .selectExpr("*", around)
        .withColumn("rank", F.expr(f"{picked_ordinal('pick', 'total', 'size')} - start"))
        .where("rank >= 0 AND rank < rows")
        .select("chunk", "rank", "pick")
    )
    ranked = keyed.withColumn("rank", F.expr(RANK_IN_CHUNK))
    return ranked.join(wanted, ["chunk", "rank"]).select("pos", "pick")


def even_sample(rows: DataFrame, k: int, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The sampled rows; with more than k rows, row ``int(i * (n / k))`` for i < k.

    The picked positions number at most k, a bound known beforehand, so they
    are broadcast to the second scan unless k itself is very large.
    """
    picked = even_positions(rows, k, chunk_bits).select("pos")
    if k <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    return rows.join(picked, "pos", "left_semi")
