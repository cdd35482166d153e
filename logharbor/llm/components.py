"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all ends of ``edges(a, b)``: the smallest node reachable.

    Every round hangs each node's larger neighbours, and the node, below its
    smallest neighbour, then smaller ones likewise, until all hang below one
    root: the number of rounds grows as the logarithm of the longest path.
    Rounds are written to the shared folder. No node's edges are collected;
    minima are pre-aggregated, so hubs are no hot groups. Empty edges give an
    empty table; loops and repeated edges do no harm; null ends are dropped.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).na.drop()
    nodes = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct()
    now = written(pairs.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    while True:
        # Large star: larger neighbours of a node go to the smallest of its neighbourhood.
        both = now.union(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        # Small star: the node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("explode(array(a, b)) AS a", "m AS b").where("a <> b").distinct()
        after = written(small, "edges")
        sums = [e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for e in (now, after)]
        now = after
        if sums[0] == sums[1]:
            break
    return nodes.join(now, "a", "left").selectExpr("a AS node", "coalesce(b, a) AS component")
