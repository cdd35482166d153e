"""What kinds are there: running-means clustering of samples, and cluster profiles.

``leader_clusters`` follows running means in row order, which is a sequential
rule, for groups of bounded size such as samples. Any number of rows is
clustered around fixed leaders (``leaderindex.fixed_leaders``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor import constants as K
from logharbor.functions.numbers import ratio, round_exact
from logharbor.functions.text import cluster_label
from logharbor.functions.vectors import dot, norm
from logharbor.operators.signatures import top_keywords
from logharbor.runtime import ship_package

ship_package()

def _unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays zero."""
    m = np.asarray(vectors.tolist(), dtype="float64")
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _running_means(pdf: pd.DataFrame, threshold: float) -> np.ndarray:
    """Cluster number per row, rows in order; each joins the nearest mean or starts a cluster."""
    raw = np.asarray(pdf["embedding"].tolist(), dtype="float64")
    unit = _unit_rows(pdf["embedding"])
    sums = np.zeros_like(raw)
    sizes = np.zeros(len(raw))
    heads = np.zeros_like(raw)
    found = np.zeros(len(raw), dtype="int32")
    n = 0
    for i, row in enumerate(unit):
        sims = heads[:n] @ row
        best = int(sims.argmax()) if n else -1
        if n and sims[best] >= threshold:
            at = best
        else:
            at, n = n, n + 1
        found[i] = at
        sums[at] += raw[i]
        sizes[at] += 1
        mean = sums[at] / sizes[at]
        length = np.sqrt(mean @ mean)
        heads[at] = mean / length if length > 0 else 0.0
    return found


def leader_clusters(vectors: DataFrame, threshold: float = K.CLUSTER_SIMILARITY, group: str | None = None,
                    limit: int = K.CLUSTER_EMBED_LINES) -> DataFrame:
    """Add ``cluster_id`` by running means in ``pos`` order, per ``group`` if named.

    Input columns: ``pos, embedding`` and the group. The rule is sequential, so
    one group is one task; a group of more than ``limit`` rows is refused.
    Sample first, or use ``leaderindex.fixed_leaders``.
    """
    key = group or "_all"
    rows = vectors if group else vectors.withColumn("_all", F.lit(0))
    schema = T.StructType([*rows.schema.fields, T.StructField("cluster_id", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > limit:
            raise ValueError(f"group of {len(pdf)} rows exceeds {limit}; sample it or cluster around fixed leaders")
        pdf = pdf.sort_values("pos", ignore_index=True)
        return pdf.assign(cluster_id=_running_means(pdf, threshold))

    out = rows.groupBy(key).applyInPandas(run, schema)
    return out if group else out.drop("_all")


def centroids(members: DataFrame, by: str = "cluster_id", weight: str | None = None) -> DataFrame:
    """``by, size, centroid, cohesion`` per cluster, in one aggregation.

    Each row counts once, or as many times as ``weight`` says: weights, weighted
    sums and weighted sums of unit vectors add up over tasks, so equal texts need
    one row. Cohesion is the mean cosine of the members to their centroid. That mean is
    the centroid's product with the mean of the unit vectors, so members need
    no second pass and no join.
    """
    vec = F.expr("CAST(embedding AS ARRAY<DOUBLE>)")
    # the length is held in a one-element array, else it would be worked out for every element
    unit = F.expr(
        f"transform(array({norm('embedding')}), n -> "
        "transform(CAST(embedding AS ARRAY<DOUBLE>), x -> coalesce(try_divide(x, n), 0D)))[0]"
    )
    times = F.lit(1) if weight is None else F.col(weight)
    mean = members.select(
        by, array_to_vector(vec).alias("_v"), array_to_vector(unit).alias("_u"), times.cast("bigint").alias("_w")
    ).groupBy(by).agg(
        F.sum("_w").alias("size"), Summarizer.mean(F.col("_v"), F.col("_w").cast("double")).alias("_v"),
        Summarizer.mean(F.col("_u"), F.col("_w").cast("double")).alias("_u")
    )
    return (
        mean.select(by, "size", vector_to_array("_v").alias("centroid"), vector_to_array("_u").alias("_unit"))
        .withColumn("cohesion", F.expr(f"coalesce(try_divide({dot('centroid', '_unit')}, {norm('centroid')}), 0D)"))
        .select(by, "size", "centroid", "cohesion")
    )


def cluster_shares(sizes: DataFrame) -> DataFrame:
    """Add ``percentage`` of all clustered rows and the display weight of each size.

    Totals come from a scalar aggregate, so the clusters stay distributed.
    """
    total = sizes.agg(F.sum("size")).scalar()
    largest = sizes.agg(F.max("size")).scalar()
    sized = sizes.withColumns({"_total": total, "_largest": largest})
    return sized.selectExpr(
        *sizes.columns,
        f"{round_exact(f'({ratio('size', '_total')}) * 100D', 1)} AS percentage",
        f"{ratio('size', '_largest')} AS weight",
    ).withColumns({
        # display sizes run from 14 to 64
        "font_size": F.expr("CAST(floor(14 + weight * 50 + 0.5D) AS INT)"), "opacity": F.expr("0.5D + weight * 0.5D"),
    })


def cluster_table(members: DataFrame, max_clusters: int | None = K.MAX_CLUSTERS, profile: DataFrame | None = None) -> DataFrame:
    """``cluster_id, label, keywords, size, percentage, centroid_similarity`` of the largest clusters.

    Members carry ``cluster_id, pos, line``, and ``embedding`` unless the clusters'
    ``profile`` (a result of ``centroids``) is given. Largest first, ties in order of creation.
    """
    profile = centroids(members) if profile is None else profile
    sized = cluster_shares(profile.select("cluster_id", "size", "cohesion"))
    words = (
        top_keywords(members, "cluster_id")
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("_words"))
        .select("cluster_id", F.col("_words.keyword").alias("keywords"))
    )
    largest = sized.orderBy(F.desc("size"), "cluster_id")
    if max_clusters is not None:
        largest = largest.limit(max_clusters)
    return (
        largest.join(words, "cluster_id", "left")
        .withColumn("keywords", F.expr("coalesce(keywords, CAST(array() AS ARRAY<STRING>))"))
        .selectExpr(
            "cluster_id", f"{cluster_label('keywords')} AS label", "keywords", "size", "percentage",
            f"{round_exact('cohesion', 4)} AS centroid_similarity",
        )
        .orderBy(F.desc("size"), "cluster_id")
    )
