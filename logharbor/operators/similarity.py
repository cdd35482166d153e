"""Ranking rows by cosine similarity to a query vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions.numbers import round_exact
from logharbor.functions.vectors import cosine, norm
from logharbor.operators.positions import head_limit


def vector_literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def with_similarity(rows: DataFrame, query: Sequence[float], vector: str = "embedding",
                    out: str = "raw_similarity") -> DataFrame:
    """Add the unrounded cosine to the query, a literal of the plan.

    The query's length is worked out once on the driver. Exploding a one-element
    array keeps the cosine from being computed again inside filters on it.
    """
    length = float(sum(float(q) * float(q) for q in query)) ** 0.5
    value = F.expr(cosine(vector, "_query", norm(vector), f"{length!r}D"))
    with_query = rows.withColumn("_query", vector_literal(query))
    return with_query.select(*rows.columns, F.explode(F.array(value)).alias(out))


def similar_rows(rows: DataFrame, query: Sequence[float], threshold: float, vector: str = "embedding") -> DataFrame:
    """Rows whose unrounded cosine reaches the threshold; adds ``similarity`` to 4 places."""
    scored = with_similarity(rows, query, vector).where(F.col("raw_similarity") >= threshold)
    return scored.withColumn("similarity", F.expr(round_exact("raw_similarity", 4))).drop("raw_similarity")


def top_similar(rows: DataFrame, n: int, bounded: bool = False) -> DataFrame:
    """The ``n`` rows of highest ``similarity``, ties in ``pos`` order.

    Rounded similarity has at most 20,001 values. Counting them gives the value
    at which n is reached; rows above it number fewer than n, and of the rows
    at it only the first by position are taken. So no task ever sorts more than
    n rows and one chunk. ``bounded`` says the input is small already, when a
    plain ordered limit is cheaper.
    """
    order = [F.desc("similarity"), F.col("pos")]
    if bounded:
        return rows.orderBy(*order).limit(n)
    levels = rows.groupBy("similarity").agg(F.count("*").alias("rows"))
    higher = (
        "sum(rows) OVER (PARTITION BY 0 ORDER BY similarity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    level = (
        levels.withColumn("before", F.expr(f"coalesce({higher}, 0L)"))
        .where(f"before < {int(n)}")
        .agg(F.min("similarity").alias("s"))
    ).scalar()
    at_level = rows.where(F.col("similarity") == level)
    bound = head_limit(at_level.select("pos"), n).scalar()
    best = (F.col("similarity") > level) | ((F.col("similarity") == level) & (F.col("pos") < bound))
    return rows.where(best).orderBy(*order).limit(n)


def rank_rows(rows: DataFrame, query: Sequence[float], top_n: int | None = None,
              threshold: float = K.PROMPT_SIMILARITY, vector: str = "embedding", bounded: bool = False) -> DataFrame:
    """Rows above the threshold, best first; all of them, or the first ``top_n``."""
    found = similar_rows(rows, query, threshold, vector)
    if top_n is None:
        return found.orderBy(F.desc("similarity"), "pos")
    return top_similar(found, top_n, bounded)
