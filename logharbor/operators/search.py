"""Where is it: keyword and semantic search with context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import quoted
from logharbor.functions.events import error_rows
from logharbor.functions.numbers import percent_text
from logharbor.functions.prompts import Prompt, resolve_prompt
from logharbor.functions.text import cut_line, keyword_match, keyword_score
from logharbor.operators.context import add_context
from logharbor.operators.embedding import Embedder, embed_one, embed_texts
from logharbor.operators.positions import CHUNK_BITS, at_positions, head_limit, position_masks, with_position
from logharbor.operators.sampling import even_sample
from logharbor.operators.similarity import similar_rows, top_similar
from logharbor.operators.timefilter import Bounds, apply_time_filter
from logharbor.runtime import BROADCAST_ROWS, cut_lineage
from logharbor.sources.logfiles import landed_zones

MATCH_COLUMNS = ("file", "line_number", "line", "context", "similarity")


def is_match(lines: DataFrame, prompt: Prompt) -> str:
    """A line matches by a keyword or by any problem tag."""
    return f"{error_rows(lines)} OR {keyword_match('line', prompt.terms, prompt.pattern)}"


def matching_lines(lines: DataFrame, prompt: Prompt, bounds: Bounds = Bounds(),
                   chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """All matches after the time filter, unranked."""
    kept = with_position(apply_time_filter(lines, bounds, prompt.window_seconds, chunk_bits))
    return kept.where(is_match(kept, prompt))


def first_matches(lines: DataFrame, prompt: Prompt, max_matches: int, bounds: Bounds = Bounds(),
                  chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The first matches in file and line order.

    Counts per chunk give a position beyond which no match is needed; the
    second pass filters on it before any pattern is tried. With a relative
    window the bound goes after the filter, which needs the ends of all files.
    """
    lines = with_position(lines)
    found = matching_lines(lines, prompt, bounds, chunk_bits)
    bound = F.col("pos") < head_limit(found, max_matches, chunk_bits).scalar()
    relative = prompt.window_seconds and not (bounds.has_hours or bounds.has_dates)
    found = found.where(bound) if relative else matching_lines(lines.where(bound), prompt, bounds, chunk_bits)
    return found.orderBy("pos").limit(max_matches)


def first_matches_landed(spark: SparkSession, path: str, prompt: Prompt, max_matches: int, bounds: Bounds = Bounds(),
                         chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The first matches of a landed table, reading no more of its files than needed.

    Files are probed in line order by the table's zones: one, two, four ... files,
    until lines before the next file hold enough matches. Continuation lines only
    look back, so a probe of the first files is exact. A relative window ends at
    each log's last dated line, for which all files are read.
    """
    n, files = max(int(max_matches), 1), 1
    if prompt.window_seconds and not (bounds.has_hours or bounds.has_dates):
        return first_matches(spark.read.parquet(path), prompt, n, bounds, chunk_bits)
    zones = landed_zones(spark, path).orderBy("first_pos", "path")
    while True:
        known = zones.limit(files + 1).collect()    # as many names as files are read, and one
        read = spark.read.parquet(*[z.path for z in known[:files]]) if known else spark.read.parquet(path).limit(0)
        if len(known) > files:
            read = read.where(F.col("pos") < known[files].first_pos)
        found = matching_lines(read, prompt, bounds, chunk_bits)
        if len(known) <= files or found.limit(n).count() >= n:
            return found.orderBy("pos").limit(n)
        files *= 2


def _shown(matches: DataFrame, lines: DataFrame, context_lines: int, bound: int) -> DataFrame:
    cut = matches.withColumn("line", F.expr(cut_line("line")))
    return add_context(cut, lines, context_lines, bound).withColumn("line_number", F.expr("line_no + 1"))


def _best(scored: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar of the scored matches, as lines.

    Positions and scores are written once, since ranking reads them three times;
    whole lines are fetched for the ``n`` best only.
    """
    top = cut_lineage(top_similar(cut_lineage(scored.select("pos", "similarity")), n))
    whole = at_positions(with_position(lines).select("file", "file_ord", "line_no", "pos", "line"), position_masks(top, n))
    return whole.join(F.broadcast(top) if n <= BROADCAST_ROWS else top, "pos")


def keyword_search(lines: DataFrame, text: str, max_matches: int = K.MAX_MATCHES,
                   context_lines: int = K.CONTEXT_LINES, bounds: Bounds = Bounds(),
                   rank_first: bool = True, embedder: Embedder | None = None,
                   chunk_bits: int = CHUNK_BITS, columns: tuple[str, ...] = MATCH_COLUMNS) -> DataFrame:
    """Matches ranked by keyword hits per word, or by an embedder if given.

    All matches are ranked and the best ``max_matches`` kept. Without
    ``rank_first`` the first ``max_matches`` in line order are taken, then ranked.
    Whole lines are scored and embedded; only the shown line is cut.
    """
    max_matches = max(int(max_matches), 1)
    prompt = resolve_prompt(lines.sparkSession, text)
    if rank_first:
        found = matching_lines(lines, prompt, bounds, chunk_bits)
    else:
        found = first_matches(lines, prompt, max_matches, bounds, chunk_bits)
    found = found.select("file", "file_ord", "line_no", "pos", "line")
    if embedder is not None:
        query = embed_one(lines.sparkSession, embedder, prompt.search_text)
        scored = similar_rows(embed_texts(found, embedder), query, 0.0).drop("embedding")
    else:
        scored = found.withColumn("similarity", F.expr(keyword_score("line", quoted(prompt.pattern))))
    ranked = _best(scored, lines, max_matches) if rank_first else scored
    shown = _shown(ranked, lines, context_lines, max_matches)
    return shown.orderBy(F.desc("similarity"), "pos").select(*columns)


def semantic_search(lines: DataFrame, text: str, embedder: Embedder, max_matches: int = K.MAX_MATCHES,
                    context_lines: int = K.CONTEXT_LINES, bounds: Bounds = Bounds(),
                    threshold: float = K.PROMPT_SIMILARITY,
                    embed_limit: int | None = None, chunk_bits: int = CHUNK_BITS,
                    columns: tuple[str, ...] = MATCH_COLUMNS) -> DataFrame:
    """Matches ranked by similarity of their vectors to the whole prompt.

    All candidates are embedded, or beyond ``embed_limit`` an even sample of them.
    Vectors and similarities are computed once; similarities are written.
    """
    spark = lines.sparkSession
    prompt = resolve_prompt(spark, text)
    found = matching_lines(lines, prompt, bounds, chunk_bits).select("file", "file_ord", "line_no", "pos", "line")
    if embed_limit is not None:
        found = even_sample(found, embed_limit, chunk_bits)
    top, query = max(int(max_matches), 1), embed_one(spark, embedder, text)
    scored = similar_rows(embed_texts(found, embedder), query, threshold).drop("embedding")
    ranked = _best(scored, lines, top)
    shown = _shown(ranked, lines, context_lines, top)
    return shown.orderBy(F.desc("similarity"), "pos").select(*columns)


def match_stats(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """``total_matches, total_lines, percent``: share of the unfiltered lines."""
    m = matches.agg(F.count("*").alias("total_matches"))
    n = lines.agg(F.count("*").alias("total_lines"))
    both = n.withColumn("total_matches", m.scalar())
    return both.selectExpr(
        "total_matches", "total_lines", f"{percent_text('total_matches', 'total_lines')} AS percent"
    )
