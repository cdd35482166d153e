"""Top vectors by similarity from lists around coarse centroids, exactly.

Vectors are stored by their nearest centroid, with the widest angle in each list. By the
triangle inequality on angles no vector of a list is nearer to a query than the
centroid's angle less that width, so lists are read from the most promising on, until
the n-th best found beats all that the rest can hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.operators.leaderindex import nearest_leader
from logharbor.operators.similarity import rank_rows, with_similarity
from logharbor.runtime import cut_lineage

# Lists at most: as many rows are looked at by the driver for a query.
MOST_LISTS = 4096
# Lists read at once at first; then twice as many.
FIRST_LISTS = 8
# Rows of a list that one file holds, about.
FILE_ROWS = 100_000
# Similarities are ranked rounded to 4 places, and angles have errors of their own.
SLACK = 1e-4


def build_lists(vectors: DataFrame, folder: str, lists: int | None = None) -> None:
    """Write ``vectors(pos, embedding, ...)`` by nearest centroid, and ``_lists``: centroid, width and rows of each.

    Centroids are vectors picked by the hash of their ``pos``, about as many as the
    root of all rows. A list with many rows is written by several tasks.
    """
    n = vectors.count()
    lists = lists or min(MOST_LISTS, max(1, math.isqrt(n)))
    heads = cut_lineage(vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("pos"), "pos").limit(lists).select(F.col("pos").alias("leader_id"), "embedding"))
    near = cut_lineage(nearest_leader(vectors, heads).withColumnRenamed("leader_id", "list"))
    sizes = near.groupBy("list").agg(F.count("*").alias("rows"), F.min("leader_similarity").alias("least"))
    known = sizes.join(heads.withColumnRenamed("leader_id", "list"), "list", "left")
    known.write.parquet(f"{folder}/_lists")
    deal = F.pmod(F.xxhash64("pos"), F.lit(max(1, -(-n // (lists * FILE_ROWS))) * 4))
    near.drop("leader_similarity").repartition("list", deal).write.partitionBy("list").parquet(f"{folder}/rows")


@dataclass(frozen=True)
class Found:
    rows: DataFrame
    lists_read: int
    lists: int


def top_of_lists(spark: SparkSession, folder: str, query: Sequence[float], n: int, threshold: float = K.PROMPT_SIMILARITY) -> Found:
    """The ``n`` most similar stored rows at or above the threshold, as ``rank_rows`` gives them, and how many lists were read."""
    stored = spark.read.parquet(f"{folder}/_lists")
    scored = with_similarity(stored.where("embedding IS NOT NULL"), query).select("list", "least", "raw_similarity").collect()
    apart = [(r.list, math.acos(max(-1.0, min(1.0, r.raw_similarity))) - math.acos(max(-1.0, min(1.0, r.least)))) for r in scored]
    # The most similar that a list can be; lists without a centroid's direction can hold anything.
    order = sorted(((math.cos(max(0.0, a)), name) for name, a in apart), reverse=True)
    order = [(2.0, r.list) for r in stored.where("embedding IS NULL").select("list").collect()] + order
    order = [x for x in order if x[0] >= threshold - SLACK]
    rows, read = spark.read.parquet(f"{folder}/rows"), FIRST_LISTS
    while True:
        some = rows.where(F.col("list").isin([name for _, name in order[:read]]) if order else F.lit(False)).drop("list")
        best = cut_lineage(rank_rows(some, query, n, threshold))
        if read >= len(order):
            break
        last = best.agg(F.count("*").alias("n"), F.min("similarity").alias("s")).first()
        if last.n >= n and last.s > order[read][0] + SLACK:
            break
        read = min(2 * read, len(order))
    return Found(best.orderBy(F.desc("similarity"), "pos"), min(read, len(order)), stored.count())
