"""From raw documents to packed batches: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Rows with a null doc_id are no documents
and go at the first stage. ``run`` writes every stage's result to the shared
folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import join_ids, written
from logharbor.llm.decontaminate import contaminated
from logharbor.llm.fertility import fertility_rules
from logharbor.llm.jaccard import jaccard_components
from logharbor.llm.language import UNKNOWN, fit_texts, held_out, identify
from logharbor.llm.length_buckets import length_buckets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids``; texts move only if the ids are too many to broadcast."""
    return join_ids(docs, written(ids.select("doc_id").distinct(), "rejected"), "doc_id", "left_anti").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's fertility bands go."""
    docs = docs.where("doc_id IS NOT NULL")
    return _without(docs, fertility_rules(docs).where("NOT kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; ``lang`` is filled where it was null."""
    texts = fit_texts(held_out(docs).where("NOT held_out"))
    named = identify(docs, texts).where(F.col("lang_pred") != UNKNOWN)
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 4-word shingles, the document with the smallest id stays."""
    found = written(jaccard_components(docs), "groups")
    kept = _without(docs, found.where("doc_id <> component_id"))
    # Rows that repeat an id are looked for among the narrow ids; texts move only if there are any.
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id"]) if repeated else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document in a batch of its length bucket."""
    return length_buckets(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

# Tokenizer tables, automata and alignment scores are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
