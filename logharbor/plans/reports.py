"""The user-facing reports: analyze, search, cluster, explain."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import quoted
from logharbor.functions.events import clock_text, error_rows
from logharbor.functions.prompts import resolve_prompt
from logharbor.functions.text import error_signature
from logharbor.operators import clustering, health, search as finding
from logharbor.operators.embedding import Embedder, embed_one, embed_texts
from logharbor.operators.leaderindex import fixed_leaders
from logharbor.operators.positions import first_rows, with_position
from logharbor.operators.sampling import even_positions, even_sample
from logharbor.operators.signatures import signature_rollup
from logharbor.operators.similarity import rank_rows, similar_rows
from logharbor.operators.timefilter import Bounds, apply_time_filter
from logharbor.runtime import cut_lineage, join_spread, ship_package, small_side

ship_package()

TextModel = Callable[[list[str]], list[str]]

log = logging.getLogger(__name__)


def day_bounds(start: str | None, end: str | None, today: str) -> Bounds:
    """Whole days as bounds; a start without an end lasts until today."""
    if start and not end:
        end = today
    return Bounds(f"{start}T00:00:00" if start else None, f"{end}T23:59:59" if end else None)


@dataclass(frozen=True)
class HealthReport:
    """Frames of one health report; all but the lines come from one small table."""

    totals: DataFrame
    pattern_counts: DataFrame
    windows: DataFrame
    high_windows: DataFrame
    error_lines: DataFrame
    prompt_filtered: bool
    prompt_threshold: float | None = None
    line_counts: DataFrame | None = None


def analyze(lines: DataFrame, bucket_minutes: int = K.BUCKET_MINUTES, threshold: float = K.HIGH_ERROR_THRESHOLD,
            bounds: Bounds = Bounds(), max_samples: int | None = None, prompt: str | None = None,
            embedder: Embedder | None = None, prompt_threshold: float = K.PROMPT_SIMILARITY,
            embed_limit: int | None = None) -> HealthReport:
    """Counts, error rate, windows and error lines.

    Lines are scanned once for all counts. With a prompt and an embedder the
    error lines become those similar to the prompt, best first; counts do not
    change. ``embed_limit`` embeds an even sample of so many lines instead of
    all. ``max_samples`` limits error lines only if given.
    """
    if bucket_minutes <= 0:
        raise ValueError("bucket_minutes must be > 0")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    summary = cut_lineage(health.bucket_summary(lines, bucket_minutes, bounds))
    samples = health.error_lines(lines, bounds)
    filtered = bool(prompt and prompt.strip() and embedder is not None and prompt_threshold > 0)
    if filtered:
        try:
            samples = similar_sample(samples, prompt.strip(), embedder, prompt_threshold, embed_limit)
        except Exception as problem:    # whatever the embedder raises, the report goes on
            log.warning("embedder failed, error lines are not filtered: %s", problem)
            filtered = False
    if not filtered and max_samples is not None:
        samples = first_rows(samples, max(int(max_samples), 1))
    return HealthReport(
        health.totals(summary), health.pattern_counts(summary), health.error_windows(summary, bucket_minutes),
        health.high_error_windows(summary, bucket_minutes, threshold), samples, filtered,
        prompt_threshold if filtered else None, health.lines_per_file(lines),
    )


def similar_sample(rows: DataFrame, prompt: str, embedder: Embedder, threshold: float,
                   limit: int | None = None) -> DataFrame:
    """Rows similar to the prompt, best first, of all rows or of an even sample; adds ``similarity``."""
    sample = embed_texts(rows if limit is None else even_sample(rows, limit), embedder)
    query = embed_one(rows.sparkSession, embedder, prompt)
    return rank_rows(sample, query, limit, threshold, bounded=limit is not None).drop("embedding")


def search(lines: DataFrame, prompt: str, max_matches: int = K.MAX_MATCHES, context_lines: int = K.CONTEXT_LINES,
           bounds: Bounds = Bounds(), embedder: Embedder | None = None,
           prompt_threshold: float = K.PROMPT_SIMILARITY, rank_first: bool = True,
           embed_limit: int | None = None) -> DataFrame:
    """Ranked matches with context; the ``matches`` of ``search_report``."""
    return search_report(
        lines, prompt, max_matches, context_lines, bounds, embedder, prompt_threshold, rank_first, embed_limit
    ).matches


@dataclass(frozen=True)
class SearchReport:
    query: str
    search_mode: str
    time_window: str | None
    matches: DataFrame
    stats: DataFrame            # total_matches, total_lines, percent
    line_counts: DataFrame      # lines of each file, unfiltered


def search_report(lines: DataFrame, prompt: str, max_matches: int = K.MAX_MATCHES,
                  context_lines: int = K.CONTEXT_LINES, bounds: Bounds = Bounds(), embedder: Embedder | None = None,
                  prompt_threshold: float = K.PROMPT_SIMILARITY, rank_first: bool = True,
                  embed_limit: int | None = None) -> SearchReport:
    """Search by similarity with an embedder that answers, else by keywords.

    Which way is decided before the job starts. ``rank_first`` and ``embed_limit``
    are those of the keyword and of the semantic search.
    """
    if not prompt.strip():
        raise ValueError("prompt is required")
    max_matches, context_lines = max(int(max_matches), 1), max(int(context_lines), 0)
    if embedder is not None:
        try:
            embed_one(lines.sparkSession, embedder, prompt)
        except Exception as problem:    # whatever the embedder raises, keywords still work
            log.warning("embedder failed, searching by keywords: %s", problem)
            embedder = None
    window = resolve_prompt(lines.sparkSession, prompt).window_text
    shown = ("pos", *finding.MATCH_COLUMNS)     # the position tells payloads the order of the file list
    if embedder is None:
        matches = finding.keyword_search(lines, prompt, max_matches, context_lines, bounds, rank_first, columns=shown)
        return SearchReport(prompt, "regex", window, matches, finding.match_stats(matches, lines), health.lines_per_file(lines))
    matches = finding.semantic_search(
        lines, prompt, embedder, max_matches, context_lines, bounds, prompt_threshold, embed_limit, columns=shown
    )
    return SearchReport(prompt, "semantic", window, matches, finding.match_stats(matches, lines), health.lines_per_file(lines))


@dataclass(frozen=True)
class ClusterReport:
    clusters: DataFrame
    members: DataFrame
    total_error_lines: int
    total_lines: int
    time_window: str | None
    prompt_threshold: float | None


def cluster(lines: DataFrame, prompt: str, embedder: Embedder, max_clusters: int = K.MAX_CLUSTERS,
            prompt_threshold: float = K.PROMPT_SIMILARITY, bounds: Bounds = Bounds(),
            threshold: float = K.CLUSTER_SIMILARITY, embed_limit: int | None = None) -> ClusterReport:
    """Groups of similar error lines, largest first.

    Lines are collapsed to signatures with digits masked, signatures are
    clustered around fixed leaders, and every line gets its signature's cluster.
    Sizes, centroids and cohesion come from the signatures, weighted by their
    lines. With ``embed_limit`` an even sample of so many lines is clustered by
    running means instead.
    """
    spark = lines.sparkSession
    asked = resolve_prompt(spark, prompt)
    kept = with_position(apply_time_filter(lines, bounds, asked.window_seconds))
    errors = kept.where(error_rows(kept)).select("file", "file_ord", "line_no", "pos", "line")
    by_prompt = asked.specific and prompt_threshold > 0
    query = embed_one(spark, embedder, asked.topic) if by_prompt else None
    total_lines = lines.count()

    def near_prompt(rows: DataFrame) -> DataFrame:
        return similar_rows(rows, query, prompt_threshold).drop("similarity") if by_prompt else rows

    if embed_limit is not None:
        embedded = cut_lineage(embed_texts(even_sample(errors, embed_limit), embedder))
        members = cut_lineage(clustering.leader_clusters(near_prompt(embedded), threshold, limit=embed_limit))
        profile, considered = clustering.centroids(members), embedded.count
    else:
        # never null, so that the join on it does not repeat the expression in a null test
        masked = f"coalesce(regexp_replace({error_signature('line')}, '[0-9]+', '#'), '')"
        keyed = errors.withColumn("_text", F.expr(masked))
        texts = keyed.groupBy("_text").agg(F.min("pos").alias("pos"), F.count("*").alias("_times"))
        embedded = cut_lineage(near_prompt(embed_texts(texts, embedder, "_text")))
        found = cut_lineage(fixed_leaders(embedded, threshold).withColumnRenamed("leader_id", "cluster_id"))
        # A signature's vector counts as often as its lines, so no line carries one.
        profile, considered = clustering.centroids(found, weight="_times"), errors.count
        lookup, few = small_side(found.select("_text", "cluster_id"))
        members = cut_lineage(join_spread(keyed, lookup, ["_text"], "pos", few).drop("_text"))
    clustered = members.count()
    return ClusterReport(
        clustering.cluster_table(members, max_clusters, profile), members.drop("embedding"),
        clustered if clustered else considered(), total_lines, asked.window_text,
        prompt_threshold if by_prompt else None,
    )


# --- documents for people and models ----------------------------------------


def _sampled_texts(rows: DataFrame, text: str, n: int) -> DataFrame:
    """One row: up to ``n`` evenly spread texts in order; the bound keeps the array small."""
    picked = rows.join(F.broadcast(even_positions(rows, n)), "pos")
    return picked.agg(F.expr(f"array_sort(collect_list(struct(pick, {text} AS text)))").alias("t")).selectExpr("t.text")


def health_payload(report: HealthReport, samples: int = K.PAYLOAD_SAMPLES, windows_shown: int = K.PAYLOAD_WINDOWS) -> DataFrame:
    """One row ``payload``: the report as compact JSON with few windows and lines."""
    patterns = report.pattern_counts.agg(F.expr(
        "map_from_entries(transform(array_sort(collect_list(struct(rank, pattern, cnt))), p -> struct(p.pattern, p.cnt)))"
    ))
    windows = (
        report.high_windows.limit(int(windows_shown))
        .withColumn("window_start", F.expr(clock_text("window_start")))
        .agg(F.expr("array_sort(collect_list(struct(window_start, window_minutes, total, errors, error_rate)))"))
    )
    return report.totals.withColumns({
        "pattern_counts": patterns.scalar(), "high_error_windows": windows.scalar(),
        "sample_error_lines": _sampled_texts(report.error_lines, "line", samples).scalar(),
    }).selectExpr(
        "to_json(struct(total_lines, error_lines, error_rate, pattern_counts, high_error_windows, sample_error_lines))"
        " AS payload"
    )


def search_payload(matches: DataFrame, lines: DataFrame, prompt: str,
                   contexts: int = K.SUMMARY_CONTEXTS, samples: int = K.PAYLOAD_SAMPLES) -> DataFrame:
    """One row ``payload``: question, counts and the contexts of the best matches."""
    # Matches are bounded by their search. Their rank is the order a reader sees.
    stats = finding.match_stats(matches, lines)
    best = matches.orderBy(F.desc("similarity"), "pos").limit(int(contexts))
    ranked = best.selectExpr("row_number() OVER (PARTITION BY 0 ORDER BY similarity DESC, pos) AS pos", "context")
    shown = _sampled_texts(ranked, "context", samples).scalar()
    return stats.withColumn("matching_lines", shown).selectExpr(
        f"to_json(struct({quoted(prompt)} AS question, total_lines, total_matches, percent, matching_lines)) AS payload"
    )


def cluster_lines(clusters: DataFrame, shown: int = K.PAYLOAD_CLUSTERS) -> DataFrame:
    """``cluster_id, text`` of the first clusters: label, size, share and keywords."""
    first = clusters.orderBy(F.desc("size"), "cluster_id").limit(int(shown))
    return first.selectExpr(
        "cluster_id", "concat(label, ' (', size, ' lines, ', percentage, '%): ', array_join(keywords, ', ')) AS text"
    )


def infer_texts(rows: DataFrame, payload: str, model: TextModel | None, out: str = "summary",
                notice: str = K.NO_MODEL_NOTICE, batch: int = K.EMBED_BATCH) -> DataFrame:
    """Add a model's text per row; a fixed notice without a model.

    The model runs on the executors and gets up to ``batch`` texts a call. A call
    that fails, or that gives another number of texts, is repeated text by text,
    so that one bad text spoils its own row only; that row gets the message.
    """
    if model is None:
        return rows.withColumn(out, F.lit(notice))

    def answers(texts: list[str]) -> list[str]:
        try:
            given = list(model(texts))
            if len(given) != len(texts):
                raise ValueError(f"model gave {len(given)} texts for {len(texts)}")
            return given
        except Exception as problem:    # whatever the model raises, the other rows go on
            if len(texts) == 1:
                return [f"no text from the model: {problem}"]
            return [a for text in texts for a in answers([text])]

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = list(series)
            yield pd.Series([a for at in range(0, len(texts), batch) for a in answers(texts[at:at + batch])], dtype="object")

    return rows.withColumn(out, call.asNondeterministic()(F.col(payload)))


def explain(lines: DataFrame, model: TextModel | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """Every distinct error once, with its count and an explanation."""
    return infer_texts(signature_rollup(lines, bounds), "signature", model, out="explanation")


def write_report(frame: DataFrame, path: str, form: str = "parquet") -> None:
    """Write one frame of a report."""
    if form not in ("parquet", "json"):
        raise ValueError("form must be parquet or json")
    getattr(frame.write.mode("errorifexists"), form)(path)
