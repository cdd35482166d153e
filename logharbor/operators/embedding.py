"""Text to vectors, with exchangeable embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import quoted
from logharbor.runtime import cut_lineage, join_spread, ship_package, small_side

ship_package()

# Stored vectors that are broadcast to the rows, at most.
STORED_AT_ONCE = 20_000

EmbedFunction = Callable[[list[str]], "np.ndarray | list[list[float]]"]


class Embedder(Protocol):
    def add(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """Rows with the vector of column ``text`` added as an array column ``out``."""


class HashedTokens:
    """Offline embedder: counts of hashed tokens, native expressions only.

    Every token adds one to the dimension its MD5 digest names.
    """

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def add(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        tokens = f"regexp_extract_all(lower({text}), {quoted(f'({K.LABEL_TOKEN})')}, 1)"
        slots = f"transform({tokens}, t -> CAST(conv(left(md5(t), 8), 16, 10) AS BIGINT) % {self.dim})"
        # the token slots are held in a one-element array so that they are computed once
        counts = f"transform(sequence(0, {self.dim - 1}), d -> CAST(size(filter(s, x -> x = d)) AS FLOAT))"
        vector = f"transform(array({slots}), s -> {counts})[0]"
        # exploding a one-element array keeps the vector from being repeated in filters on it
        return rows.selectExpr("*", f"explode(array({vector})) AS {out}")


class FunctionEmbedder:
    """Embedder around a Python function called with up to ``batch`` texts.

    The function runs on the executors and must return one vector per text, in
    order. Equal texts of one Arrow batch are sent once.
    """

    def __init__(self, function: EmbedFunction, batch: int = K.EMBED_BATCH) -> None:
        self.function = function
        self.batch = batch

    def add(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        function, batch = self.function, self.batch

        @F.pandas_udf("array<float>")
        def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in texts:
                codes, distinct = pd.factorize(series.fillna(""))
                found: list = []
                for at in range(0, len(distinct), batch):
                    asked = list(distinct[at:at + batch])
                    given = list(function(asked))
                    if len(given) != len(asked):
                        raise ValueError(f"embedder gave {len(given)} vectors for {len(asked)} texts")
                    found.extend(given)
                yield pd.Series([np.asarray(found[c], dtype="float32") for c in codes])

        # marked so that the optimizer does not call it again inside filters
        return rows.withColumn(out, embed.asNondeterministic()(F.col(text)))


class StoredVectors:
    """Embedder with a memory: a table of vectors by the hash of their text, in a shared folder.

    Each distinct text is embedded once, whatever partitions and runs it turns up in: texts
    are reduced to distinct ones, those the table holds are left out, the rest is embedded and added,
    and rows get their vectors by a join on the hash. ``add`` therefore runs a job. A
    null text counts as an empty one. Use one folder for one model.
    """

    SCHEMA = "key string, vector array<float>"

    def __init__(self, embedder: Embedder, folder: str) -> None:
        self.embedder, self.folder = embedder, folder

    def _known(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.SCHEMA).parquet(self.folder)

    def add(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        spark = rows.sparkSession
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.folder)
        keyed = rows.withColumns({"_key": F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256),
                                  "_row": F.monotonically_increasing_id()})
        asked = keyed.groupBy("_key").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
        new = asked.join(self._known(spark).select(F.col("key").alias("_key")), "_key", "left_anti")
        # The texts to be embedded are written first, so that a repeated task does not ask for others.
        found = self.embedder.add(cut_lineage(new), "_text", "_vector")
        found.select(F.col("_key").alias("key"), F.col("_vector").cast("array<float>").alias("vector")).write.mode("append").parquet(self.folder)
        # Two runs at once may have added the same text; one of its vectors is as good as the other.
        held = self._known(spark).join(asked.select(F.col("_key").alias("key")), "key", "left_semi").groupBy("key").agg(F.first("vector").alias(out))
        vectors, few = small_side(held.withColumnRenamed("key", "_key"), STORED_AT_ONCE)
        return join_spread(keyed, vectors, ["_key"], "_row", few).select(*rows.columns, out)


def embed_texts(rows: DataFrame, embedder: Embedder, text: str = "line", out: str = "embedding") -> DataFrame:
    return embedder.add(rows, text, out)


def embed_one(spark: SparkSession, embedder: Embedder, text: str) -> list[float]:
    """Vector of a single text, such as a prompt."""
    row = embedder.add(spark.sql("SELECT :text AS t", args={"text": text}), "t", "v").first()
    return [float(x) for x in row.v]
