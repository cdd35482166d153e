"""SQL over the given tables that gives the same rows as the registered queries.

Written on its own terms: plain windows over whole files, nested replacements,
``printf`` for rounding. It shares only the fixed values and the text of the
test lines with the library.
"""

from __future__ import annotations

from logharbor import constants as K
from logharbor.plans.fixtures import FILE_SQL, LINE_SQL, PROMPT_SQL

CHECKS: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(items) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]"


def _ts(line: str) -> str:
    return (
        f"coalesce(try_cast(regexp_extract({line}, {_q(K.DASH_TIMESTAMP)}) AS TIMESTAMP), "
        f"try_cast(replace(regexp_extract({line}, {_q(K.SLASH_TIMESTAMP)}), '/', '-') AS TIMESTAMP))"
    )


def _tag(line: str, tag: str) -> str:
    flag = "" if tag in K.CASE_SENSITIVE_TAGS else ", 'i'"
    return f"regexp_matches({line}, {_q(K.TAG_PATTERNS[tag])}{flag})"


def _any(line: str) -> str:
    return "(" + " OR ".join(_tag(line, t) for t in K.TAG_PATTERNS) + ")"


def _rnd(x: str, digits: int = 4) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _clock(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


_TAGS = ", ".join(f"{_tag('line', t)} AS {t}_hit" for t in K.TAG_PATTERNS)

LINES = f"""log_lines AS (
  SELECT event_id, {FILE_SQL} AS file, user_id % 4 AS file_ord,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS line_number, {LINE_SQL} AS line
  FROM events),
ev AS (SELECT *, {_ts('line')} AS ts, {_any('line')} AS is_error, {_TAGS} FROM log_lines)"""


def check(name: str, body: str, *ctes: str) -> None:
    CHECKS[name] = "WITH RECURSIVE " + ",\n".join([LINES, *ctes]) + "\n" + body


def _bucket(m: int) -> str:
    return f"date_trunc('minute', ts) - to_minutes(CAST(minute(ts) % {m} AS INTEGER))"


def _windows(m: int, where: str = "true", having: str = "true") -> str:
    return f"""
SELECT {_clock('b')} AS window_start, CAST({m} AS INTEGER) AS window_minutes, count(*) AS total,
       count(*) FILTER (WHERE is_error) AS errors,
       {_rnd('count(*) FILTER (WHERE is_error) / count(*)::DOUBLE')} AS error_rate
FROM (SELECT *, {_bucket(m)} AS b FROM ev WHERE ts IS NOT NULL AND ({where}))
GROUP BY b HAVING {having} ORDER BY window_start"""


def _totals(where: str = "true", source: str = "ev") -> str:
    return f"""
SELECT count(*) AS total_lines, count(*) FILTER (WHERE is_error) AS error_lines,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE {_rnd('count(*) FILTER (WHERE is_error) / count(*)::DOUBLE')} END AS error_rate
FROM {source} WHERE {where}"""


_HIGH = "count(*) FILTER (WHERE is_error) / count(*)::DOUBLE >= 0.2"
_DAY = "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'"


def _kept(seed: str, source: str = "ev", file: str = "file") -> list[str]:
    """Continuation lines by islands over whole files; result in ``kept``."""
    return [
        f"flagged AS (SELECT *, coalesce({seed}, false) AS seed FROM {source})",
        f"""remaining AS (SELECT *, line_number - lag(line_number) OVER (PARTITION BY {file} ORDER BY line_number) AS gap
  FROM flagged WHERE seed OR ts IS NULL)""",
        f"""islands AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END)
  OVER (PARTITION BY {file} ORDER BY line_number) AS island FROM remaining)""",
        f"""kept AS (SELECT * FROM (SELECT *, max(CASE WHEN seed THEN 1 ELSE 0 END)
  OVER (PARTITION BY {file}, island ORDER BY line_number) AS alive FROM islands) WHERE alive = 1)""",
    ]


_NUMBERED = "SELECT file, line_number, line FROM"

# --- lines and scalar functions ---

check("numbered_lines", f"{_NUMBERED} log_lines")
check("parsed_lines", f"""
SELECT event_id, {_clock('ts')} AS ts,
       concat_ws(',', {', '.join(f"CASE WHEN {t}_hit THEN '{t}' END" for t in K.TAG_PATTERNS)}) AS tags, is_error,
       {_clock(_bucket(5))} AS bucket_5, {_clock(_bucket(7))} AS bucket_7, {_clock(_bucket(90))} AS bucket_90
FROM ev""")

_PHRASE = _q(K.TIME_PHRASE)
PROMPTS = f"""p0 AS (SELECT event_id AS prompt_id, {PROMPT_SQL} AS prompt FROM events)"""
_SECONDS = f"""CASE WHEN try_cast(regexp_extract(prompt, {_PHRASE}, 1, 'i') AS BIGINT) > 0
  THEN CAST(regexp_extract(prompt, {_PHRASE}, 1, 'i') AS BIGINT) *
       CASE lower(regexp_extract(prompt, {_PHRASE}, 2, 'i')[1]) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END
  END"""
_STRIPPED = (
    f"trim(regexp_replace(regexp_replace(regexp_replace(prompt, {_PHRASE}, '', 'gi'), "
    r"'\b(for|from|in|within|of)\s+the\s*$', '', 'gi'), '\bago\b', '', 'gi'))"
)
P1 = f"p1 AS (SELECT *, {_SECONDS} AS seconds, {_STRIPPED} AS stripped FROM p0)"


def _terms(text: str) -> str:
    stop = _words(K.PROMPT_STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({text}), {_q(K.PROMPT_TOKEN)}), lambda t: NOT list_contains({stop}, t))"


CHECKS["prompt_windows"] = f"""WITH {PROMPTS}, {P1}
SELECT prompt_id, CAST(seconds AS VARCHAR) AS seconds,
       CASE seconds // 86400 WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE concat(seconds // 86400, ' days, ') END
       || printf('%d:%02d:%02d', seconds % 86400 // 3600, seconds % 3600 // 60, seconds % 60) AS window_text,
       stripped, CASE WHEN seconds IS NULL THEN prompt ELSE stripped END AS search_text
FROM p1"""
CHECKS["prompt_keywords"] = f"""WITH {PROMPTS}, p2 AS (SELECT prompt_id, {_terms('prompt')} AS t FROM p0)
SELECT prompt_id, array_to_string(t, ' ') AS terms,
       CASE WHEN len(t) = 0 THEN {_q(K.FALLBACK_PATTERN)}
            ELSE replace(replace(array_to_string(t, '|'), '-', '\\-'), '.', '\\.') END AS pattern
FROM p2"""
CHECKS["prompt_specific"] = f"""WITH {PROMPTS}, {P1}
SELECT prompt_id, length(stripped) >= 5 AND NOT regexp_matches(stripped, {_q(K.GENERIC_PROMPT)}, 'i') AS is_specific FROM p1"""
CHECKS["conversation_keywords"] = f"""WITH p1 AS (SELECT *, text AS prompt, {_terms('text')} AS t FROM conversations)
SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5, CAST({_SECONDS} AS VARCHAR) AS seconds FROM p1"""

_PATTERN = "'database|connection|timeout'"
_SCORE = (
    f"len(regexp_extract_all(line, '(?i)' || {_PATTERN})) / "
    r"greatest(len(regexp_extract_all(line, '\S+')), 1)::DOUBLE"
)
check("keyword_scores", f"SELECT event_id, {_rnd(_SCORE)} AS score FROM log_lines")

_SIG = "regexp_replace(line, '^" + K.SIGNATURE_TIMESTAMP + r"\s*', '')"
_SIG = f"regexp_replace({_SIG}, '^({'|'.join(K.SIGNATURE_LEVELS)})\\s*', '', 'i')"
for _ in range(2):
    _SIG = f"regexp_replace({_SIG}, '^\\[[\\w\\-]+\\]\\s*', '')"
check("error_signatures", f"""
SELECT event_id, trim({_SIG}) AS signature, substr(trim({_SIG}), 1, 20) AS short_signature FROM log_lines""")

DOCS = """docs AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"""
_TOKENS = (
    f"list_filter(regexp_extract_all(lower(line), {_q(K.LABEL_TOKEN)}), lambda t: NOT list_contains({_words(K.LABEL_STOPWORDS)}, t))"
)
# distinct tokens in order of first occurrence
_DISTINCT = "list_filter(toks, lambda t, i: list_position(toks, t) = i)"
CHECKS["line_tokens"] = f"""WITH {DOCS}, d AS (SELECT doc_id, line_no, {_TOKENS} AS toks FROM docs)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(len(list_distinct(toks)) AS INTEGER) AS n_tokens,
       md5(array_to_string({_DISTINCT}, ' ')) AS tokens_md5 FROM d"""

# --- health ---

check("totals", _totals())
CHECKS["document_totals"] = f"""WITH {DOCS}, ev AS (SELECT {_any('line')} AS is_error FROM docs) {_totals()}"""
_COUNTS = "\nUNION ALL ".join(
    f"SELECT '{t}' AS pattern, {i} AS tag_no, count(*) AS cnt, min(file_ord * 10000000000 + line_number) AS first_at FROM ev WHERE {t}_hit"
    for i, t in enumerate(K.TAG_PATTERNS)
)
check("pattern_counts", """SELECT * FROM (SELECT pattern, cnt,
  CAST(row_number() OVER (ORDER BY cnt DESC, first_at, tag_no) AS INTEGER) AS rank FROM counted WHERE cnt > 0) WHERE rank <= 8""",
      f"counted AS ({_COUNTS})")
check("pattern_share", f"""SELECT pattern, cnt, {_rnd('cnt / (sum(cnt) OVER ())::DOUBLE * 100.0', 1)} AS percent
FROM counted WHERE cnt > 0""", f"counted AS ({_COUNTS})")
check("error_windows", _windows(5))
check("high_error_windows", _windows(60, having=_HIGH))
check("windows_7min", _windows(7))
check("windows_90min", _windows(90))
check("analyze_hour_wrap", _totals("ts IS NULL OR hour(ts) >= 22 OR hour(ts) <= 4"))
check("analyze_date_range", _windows(60, _DAY, _HIGH))
check("error_lines", f"{_NUMBERED} ev WHERE is_error")
check("first_error_lines", f"{_NUMBERED} ev WHERE is_error ORDER BY file_ord, line_number LIMIT 30")
check("lines_per_file", "SELECT file, count(*) AS lines FROM log_lines GROUP BY file")

# --- time filters ---

check("filter_date_range", f"{_NUMBERED} kept", *_kept(_DAY))
check("filter_hour_range", f"{_NUMBERED} kept", *_kept("hour(ts) >= 22 OR hour(ts) <= 0"))
_NOW = "nows AS (SELECT file AS f, arg_max(ts, line_number) AS now_ts FROM ev WHERE ts IS NOT NULL GROUP BY file)"
_TIMED = "timed AS (SELECT ev.*, now_ts FROM ev LEFT JOIN nows ON file = f)"


def _last(interval: str) -> list[str]:
    return [_NOW, _TIMED, *_kept(f"now_ts IS NULL OR ts BETWEEN now_ts - INTERVAL {interval} AND now_ts", "timed")]


check("filter_last_2h", f"{_NUMBERED} kept", *_last("2 HOURS"))
check("filter_precedence", f"{_NUMBERED} kept",
      *_kept("hour(ts) BETWEEN 8 AND 10 AND ts >= TIMESTAMP '2024-01-05 00:00:00'"))
check("last_times", f"SELECT CAST(right(left(f, 5), 1) AS INTEGER) AS file_ord, {_clock('now_ts')} AS last_time FROM nows", _NOW)

# --- search ---

_HIT = f"(is_error OR regexp_matches(line, {_PATTERN}, 'i'))"
check("keyword_matches", f"{_NUMBERED} ev WHERE {_HIT}")


def _around(c: int) -> str:
    return f"""around AS (SELECT file AS af, line_number AS an, substr(array_to_string(list(line) OVER (PARTITION BY file
  ORDER BY line_number ROWS BETWEEN {c} PRECEDING AND {c} FOLLOWING), chr(10)), 1, 2048) AS context FROM log_lines)"""


def _search(source: str, score: str) -> str:
    return f"""SELECT file, line_number, substr(line, 1, 1024) AS line, context, {score} AS similarity
FROM {source} JOIN around ON file = af AND line_number = an ORDER BY similarity DESC, file_ord, line_number"""


check("keyword_search", _search("m", "s"), _around(2),
      f"m AS (SELECT *, {_rnd(_SCORE)} AS s FROM ev WHERE {_HIT} ORDER BY s DESC, file_ord, line_number LIMIT 200)")
_PURCHASE = _SCORE.replace(_PATTERN, "'purchase'")
check("keyword_search_window", _search("m", "s"), _around(0), *_last("2 DAYS"),
      f"""m AS (SELECT *, {_rnd(_PURCHASE)} AS s FROM kept WHERE is_error OR regexp_matches(line, 'purchase', 'i')
  ORDER BY s DESC, file_ord, line_number LIMIT 5000)""")
check("keyword_search_best", _search("m", "s"), _around(1),
      f"m AS (SELECT *, {_rnd(_SCORE)} AS s FROM ev WHERE {_HIT} ORDER BY s DESC, file_ord, line_number LIMIT 100)")
check("search_context", "SELECT file, line_number, context FROM ev JOIN around ON file = af AND line_number = an WHERE is_error",
      _around(2))
check("match_stats", f"""SELECT count(*) FILTER (WHERE {_HIT}) AS total_matches, count(*) AS total_lines,
  CASE WHEN count(*) > 0 THEN printf('%.2f%%', count(*) FILTER (WHERE {_HIT}) / count(*)::DOUBLE * 100.0) ELSE 'unknown' END AS percent
FROM ev""")


check("first_matches", f"{_NUMBERED} ev WHERE {_HIT} ORDER BY file_ord, line_number LIMIT 200")
check("prompt_matches", """SELECT prompt_id, array_to_string(ts, ' ') AS terms, CAST(errors + coalesce(n, CASE WHEN len(ts) = 0 THEN fallback ELSE 0 END) AS BIGINT) AS matches
FROM asked LEFT JOIN found USING (ts), totals""",
      PROMPTS, P1, f"""asked AS (SELECT prompt_id, list_sort(list_distinct({_terms("CASE WHEN seconds IS NULL THEN prompt ELSE stripped END")})) AS ts FROM p1)""",
      "texts AS (SELECT lower(line) AS low, count(*) AS n FROM ev WHERE NOT is_error GROUP BY low)",
      "sets AS (SELECT DISTINCT ts FROM asked WHERE len(ts) > 0)",
      "found AS (SELECT ts, sum(n) AS n FROM sets, texts WHERE len(list_filter(ts, lambda t: contains(low, t))) > 0 GROUP BY ts)",
      f"""totals AS (SELECT count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE NOT is_error AND
  regexp_matches(line, {_q(K.FALLBACK_PATTERN)}, 'i')) AS fallback FROM ev)""")


def _slots(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all(lower({text}), {_q(K.LABEL_TOKEN)}), "
        "lambda t: CAST('0x' || left(md5(t), 8) AS BIGINT) % 64)"
    )


def _counts(slots: str) -> str:
    return f"list_transform(range(64), lambda d: CAST(len(list_filter({slots}, lambda s: s = d)) AS DOUBLE))"


def _vectors_of(source: str, topic: str, text: str = "line") -> list[str]:
    return [
        f"slotted AS (SELECT *, {_slots(text)} AS sl FROM {source})",
        f"embedded AS (SELECT *, {_counts('sl')} AS vec FROM slotted)",
        f"qs AS (SELECT {_slots(_q(topic))} AS qsl)",
        f"qv AS (SELECT {_counts('qsl')} AS q FROM qs)",
        """scored AS (SELECT embedded.*, CASE WHEN len(list_filter(vec, lambda x: x <> 0)) = 0 THEN 0.0
  ELSE list_cosine_similarity(vec, q) END AS raw FROM embedded, qv)""",
    ]


def _sampled(source: str, k: int, name: str) -> list[str]:
    return [
        f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY file_ord, line_number) - 1 AS o, count(*) OVER () AS n FROM {source})""",
        f"""{name}_p AS (SELECT CASE WHEN n > {k} THEN CAST(floor(i * (n::DOUBLE / {k}::DOUBLE)) AS BIGINT) ELSE i END AS p
  FROM (SELECT max(n) AS n FROM {name}_o), range({k}) r(i) WHERE i < n)""",
        f"{name} AS (SELECT * FROM {name}_o WHERE o IN (SELECT p FROM {name}_p))",
    ]


_TOPIC = "database connection refused"
_THIT = "(is_error OR regexp_matches(line, 'database|connection|refused', 'i'))"
check("semantic_search", _search("best", "s"), _around(1), f"c AS (SELECT * FROM ev WHERE {_THIT})",
      *_vectors_of("c", _TOPIC),
      f"best AS (SELECT *, {_rnd('raw')} AS s FROM scored WHERE raw >= 0.3 ORDER BY s DESC, file_ord, line_number LIMIT 300)")
check("semantic_search_sampled", _search("best", "s"), _around(0), f"c AS (SELECT * FROM ev WHERE {_THIT})",
      *_sampled("c", 500, "picked"), *_vectors_of("picked", _TOPIC),
      f"best AS (SELECT *, {_rnd('raw')} AS s FROM scored WHERE raw >= 0.1 ORDER BY s DESC, file_ord, line_number LIMIT 50)")
check("reranked_matches", _search("best", "s"), _around(0),
      f"c AS (SELECT * FROM ev WHERE {_THIT} ORDER BY file_ord, line_number LIMIT 300)", *_vectors_of("c", _TOPIC),
      f"best AS (SELECT *, {_rnd('raw')} AS s FROM scored WHERE raw >= 0.0)")
check("sample_near_prompt", f"SELECT file, line_number, {_rnd('raw')} AS similarity FROM scored WHERE raw >= 0.3",
      "c AS (SELECT * FROM ev WHERE is_error)", *_vectors_of("c", _TOPIC))
check("even_sample", f"{_NUMBERED} picked", "c AS (SELECT * FROM ev WHERE is_error)", *_sampled("c", 300, "picked"))
check("even_sample_all", f"{_NUMBERED} ev WHERE is_error")

# --- documents ---

_HEALTH_JSON = f"""
SELECT '{{"total_lines":' || t.total_lines || ',"error_lines":' || t.error_lines || ',"error_rate":' || t.error_rate
  || ',"pattern_counts":{{' || pc.j || '}},"high_error_windows":[' || hw.j || '],"sample_error_lines":[' || sl.j || ']}}' AS payload
FROM t, pc, hw, sl"""
check("health_document", _HEALTH_JSON, f"t AS ({_totals()})", f"counted AS ({_COUNTS})",
      """pc AS (SELECT string_agg('"' || pattern || '":' || cnt, ',' ORDER BY cnt DESC, first_at, tag_no) AS j FROM counted WHERE cnt > 0)""",
      f"w AS ({_windows(60, having=_HIGH)} LIMIT 10)",
      """hw AS (SELECT string_agg('{"window_start":"' || window_start || '","window_minutes":60,"total":' || total || ',"errors":'
  || errors || ',"error_rate":' || error_rate || '}', ',' ORDER BY window_start) AS j FROM w)""",
      "c AS (SELECT * FROM ev WHERE is_error)", *_sampled("c", 30, "picked"),
      """sl AS (SELECT string_agg(to_json(line)::VARCHAR, ',' ORDER BY o) AS j FROM picked)""")
check("search_document", """
SELECT '{"question":"database connection problems timeout","total_lines":' || (SELECT count(*) FROM ev) || ',"total_matches":'
  || (SELECT count(*) FROM m) || ',"percent":"' || printf('%.2f%%', (SELECT count(*) FROM m) / (SELECT count(*) FROM ev)::DOUBLE * 100.0)
  || '","matching_lines":[' || (SELECT string_agg(to_json(context)::VARCHAR, ',' ORDER BY similarity DESC, file, line_number) FROM b) || ']}' AS payload""",
      _around(1), f"m AS (SELECT *, {_rnd(_SCORE)} AS s FROM ev WHERE {_HIT} ORDER BY s DESC, file_ord, line_number LIMIT 200)",
      f"b AS (SELECT * FROM ({_search('m', 's')}) ORDER BY similarity DESC, file, line_number LIMIT 20)")

# --- signatures and words ---

_WHOLE_SIG = f"trim({_SIG})"
check("signature_rollup", f"""
SELECT {_WHOLE_SIG} AS signature, count(*) AS cnt, {_clock('min(ts)')} AS first_seen, {_clock('max(ts)')} AS last_seen
FROM ev WHERE is_error GROUP BY 1""")
check("explanations", f"""
SELECT {_WHOLE_SIG} AS signature, count(*) AS cnt, {_q(K.NO_MODEL_NOTICE)} AS explanation FROM ev WHERE is_error GROUP BY 1""")


check("explained_errors", f"""
SELECT sig AS signature, count(*) AS cnt, CASE WHEN contains(sig, 'disk') THEN 'no text from the model: disks are not explained'
  ELSE len(regexp_extract_all(sig, '\\S+')) || ' words from ' || regexp_extract(sig, '\\S+') END AS explanation
FROM (SELECT {_WHOLE_SIG} AS sig FROM ev WHERE is_error) GROUP BY sig""")
check("written_report", "SELECT pattern, cnt, form FROM counted, (VALUES ('parquet'), ('json')) AS forms(form) WHERE cnt > 0", f"counted AS ({_COUNTS})")


def _top_words(grp: str) -> list[str]:
    return [
        f"firsts AS (SELECT {grp}, loc, unnest(toks) AS keyword, unnest(range(len(toks))) AS k FROM toked)",
        f"per_line AS (SELECT {grp}, loc, keyword, min(k) AS k FROM firsts GROUP BY ALL)",
        f"""word_counts AS (SELECT {grp}, keyword, count(*) AS cnt, min((loc, k)) AS first_at FROM per_line GROUP BY {grp}, keyword)""",
        f"""ranked AS (SELECT {grp}, CAST(row_number() OVER (PARTITION BY {grp} ORDER BY cnt DESC, first_at) AS INTEGER) AS rank,
  keyword, cnt FROM word_counts)""",
    ]


CHECKS["top_keywords"] = "WITH " + ",\n".join([
    DOCS, f"toked AS (SELECT lang, doc_id * 1000000 + line_no AS loc, {_TOKENS} AS toks FROM docs)", *_top_words("lang")
]) + "\nSELECT * FROM ranked WHERE rank <= 5"
check("error_keywords", "SELECT * FROM ranked WHERE rank <= 5",
      f"toked AS (SELECT file, line_number AS loc, {_TOKENS} AS toks FROM ev WHERE is_error)", *_top_words("file"))

# --- vectors ---

_V = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_cosine_similarity(e, qe) AS raw FROM v, q)"""
CHECKS["cosine_to_query"] = f"WITH {_V} SELECT vec_id, {_rnd('raw')} AS similarity FROM s"
CHECKS["similarity_filter"] = f"WITH {_V} SELECT vec_id, {_rnd('raw')} AS similarity FROM s WHERE raw >= 0.1"
CHECKS["vector_topk"] = f"""WITH {_V} SELECT vec_id, label, {_rnd('raw')} AS similarity FROM s WHERE raw >= 0.05
ORDER BY similarity DESC, vec_id LIMIT 20"""
CHECKS["vector_topk_lists"] = CHECKS["vector_topk"]
_C = """u AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
c AS (SELECT label, dim, avg(x) AS mean FROM u GROUP BY label, dim),
cv AS (SELECT label AS l, list(mean ORDER BY dim) AS centroid FROM c GROUP BY label),
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
CHECKS["centroids"] = f"WITH {_C} SELECT label, CAST(dim AS INTEGER) AS dim, {_rnd('mean', 6)} AS mean FROM c"
CHECKS["cohesion"] = f"""WITH {_C} SELECT label, {_rnd('avg(list_cosine_similarity(e, centroid))')} AS centroid_similarity
FROM v JOIN cv ON label = l GROUP BY label"""
CHECKS["nearest_label"] = f"""WITH {_C}, pairs AS (SELECT vec_id, l, list_cosine_similarity(e, centroid) AS sim FROM v, cv)
SELECT vec_id, CAST(arg_min(l, (-sim, l)) AS BIGINT) AS leader_id, {_rnd('max(sim)')} AS similarity FROM pairs GROUP BY vec_id"""
CHECKS["cluster_sizes"] = f"""WITH z AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
r AS (SELECT *, size / (max(size) OVER ())::DOUBLE AS w, size / (sum(size) OVER ())::DOUBLE * 100.0 AS p FROM z)
SELECT label, size, {_rnd('p', 1)} AS percentage, {_rnd('w')} AS weight,
       CAST(floor(14 + w * 50 + 0.5) AS INTEGER) AS font_size, {_rnd('0.5 + w * 0.5')} AS opacity FROM r"""

# --- clusters ---


def _running_means(source: str, t: float) -> str:
    """Sequential clustering of ``source(grp, idx, e)``, idx from 1 within grp; one step per row."""
    return f"""rm AS (
  SELECT grp, idx, CAST(0 AS INTEGER) AS cid, [{{'s': e, 'n': 1}}] AS cl FROM {source} WHERE idx = 1
  UNION ALL
  SELECT grp, idx, CAST(CASE WHEN best >= {t} THEN list_position(sims, best) - 1 ELSE len(cl) END AS INTEGER),
    CASE WHEN best >= {t} THEN list_transform(cl, lambda c, i: CASE WHEN i = list_position(sims, best)
           THEN {{'s': list_transform(range(1, len(e) + 1), lambda d: c.s[d] + e[d]), 'n': c.n + 1}} ELSE c END)
         ELSE list_append(cl, {{'s': e, 'n': 1}}) END
  FROM (SELECT *, list_max(sims) AS best FROM (
    SELECT n.grp, n.idx, n.e, rm.cl, list_transform(rm.cl, lambda c: list_cosine_similarity(n.e, c.s)) AS sims
    FROM rm JOIN {source} n ON n.grp = rm.grp AND n.idx = rm.idx + 1)))"""


def _fixed_leaders(source: str, t: float) -> list[str]:
    """Leaders of ``source(grp, idx, key, e)`` in idx order within grp, then each row's best leader up to itself."""
    return [
        f"""fl AS (
  SELECT grp, idx, [{{'k': key, 'e': e}}] AS heads FROM {source} WHERE idx = 1
  UNION ALL
  SELECT n.grp, n.idx, CASE WHEN list_max(list_transform(fl.heads, lambda h: list_cosine_similarity(n.e, h.e))) < {t}
    THEN list_append(fl.heads, {{'k': n.key, 'e': n.e}}) ELSE fl.heads END
  FROM fl JOIN {source} n ON n.grp = fl.grp AND n.idx = fl.idx + 1)""",
        """heads AS (SELECT grp AS hg, h.k AS k, h.e AS he FROM
  (SELECT grp, unnest(heads) AS h FROM (SELECT grp, heads FROM fl QUALIFY row_number() OVER (PARTITION BY grp ORDER BY idx DESC) = 1)))""",
        f"""joined AS (SELECT n.*, h.k, CASE WHEN h.k = n.key THEN 1.0 ELSE list_cosine_similarity(n.e, h.he) END AS sim
  FROM {source} n JOIN heads h ON h.hg = n.grp AND h.k <= n.key)""",
        """assigned AS (SELECT key, arg_min(k, (-sim, k)) AS leader_id, max(sim) AS sim FROM joined GROUP BY key)""",
    ]


_VEC = "vec_id, label, CAST(embedding AS DOUBLE[]) AS e"
_ALL_VECTORS = f"v AS (SELECT {_VEC}, 0 AS grp, vec_id AS key, row_number() OVER (ORDER BY vec_id) AS idx FROM embeddings)"
CHECKS["leader_clusters"] = "WITH RECURSIVE " + ",\n".join([_ALL_VECTORS, *_fixed_leaders("v", 0.3)]) + (
    "\nSELECT key AS vec_id, dense_rank() OVER (ORDER BY leader_id) - 1 AS cluster_id FROM assigned")
CHECKS["leader_clusters_by_label"] = "WITH RECURSIVE " + ",\n".join([
    f"v AS (SELECT {_VEC}, label AS grp, vec_id AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS idx FROM embeddings)",
    *_fixed_leaders("v", 0.3),
]) + "\nSELECT key AS vec_id, label, leader_id FROM assigned JOIN v USING (key)"
CHECKS["leader_clusters_sampled"] = "WITH RECURSIVE " + ",\n".join([
    "numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)",
    "picked AS (SELECT * FROM numbered WHERE n <= 2000 OR i IN (SELECT CAST(floor(k * (n / 2000.0::DOUBLE)) AS BIGINT) FROM range(2000) r(k), (SELECT max(n) AS n FROM numbered)))",
    f"v AS (SELECT {_VEC}, 0 AS grp, row_number() OVER (ORDER BY vec_id) AS idx FROM picked)", _running_means("v", 0.3),
]) + "\nSELECT vec_id, cid AS cluster_id FROM rm JOIN v USING (grp, idx)"
CHECKS["fixed_leader_clusters"] = "WITH RECURSIVE " + ",\n".join([_ALL_VECTORS, *_fixed_leaders("v", 0.3)]) + (
    f"\nSELECT key AS vec_id, leader_id, {_rnd('sim')} AS similarity FROM assigned")


def _cluster_table(members: str) -> list[str]:
    """Label, keywords, share and cohesion from ``members(cluster_id, loc, line, e)``."""
    return [
        f"toked AS (SELECT cluster_id, loc, {_TOKENS} AS toks FROM {members})", *_top_words("cluster_id"),
        """kw AS (SELECT cluster_id, list(keyword ORDER BY rank) AS keywords FROM ranked WHERE rank <= 5 GROUP BY cluster_id)""",
        f"""dims AS (SELECT cluster_id, unnest(e) AS x, unnest(range(len(e))) AS dim FROM {members})""",
        """means AS (SELECT cluster_id AS c, list(m ORDER BY dim) AS centroid FROM
  (SELECT cluster_id, dim, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY cluster_id)""",
        f"""sized AS (SELECT cluster_id, count(*) AS size, avg(list_cosine_similarity(e, centroid)) AS coh
  FROM {members} JOIN means ON c = cluster_id GROUP BY cluster_id)""",
        f"""report AS (SELECT s.cluster_id, upper(array_to_string(keywords[1:3], ' ')) AS label,
  array_to_string(keywords, ' ') AS keywords, size, {_rnd('size / (sum(size) OVER ())::DOUBLE * 100.0', 1)} AS percentage,
  {_rnd('coh')} AS centroid_similarity FROM sized s JOIN kw k ON s.cluster_id = k.cluster_id)""",
    ]


_LOC = "file_ord * 1099511627776 + line_number - 1"
_TEXTS = [
    f"""c AS (SELECT {_LOC} AS loc, file, line_number, line, regexp_replace({_WHOLE_SIG}, '[0-9]+', '#', 'g') AS txt FROM ev WHERE is_error)""",
    "texts AS (SELECT txt, min(loc) AS key FROM c GROUP BY txt)",
]
_MEMBERS = "members AS (SELECT leader_id AS cluster_id, loc, line, file, line_number, e FROM c JOIN v USING (txt) JOIN assigned USING (key))"
_CLUSTERED = [
    *_TEXTS, *_vectors_of("texts", "x", "txt"),
    "v AS (SELECT 0 AS grp, key, txt, vec AS e, row_number() OVER (ORDER BY key) AS idx FROM embedded)",
    *_fixed_leaders("v", K.CLUSTER_SIMILARITY), _MEMBERS, *_cluster_table("members"),
]
check("cluster_report", "SELECT * FROM report ORDER BY size DESC, cluster_id LIMIT 20", *_CLUSTERED)
check("cluster_lines", f"""SELECT cluster_id, label || ' (' || size || ' lines, ' || percentage || '%): ' || replace(keywords, ' ', ', ') AS text,
  {_q(K.NO_MODEL_NOTICE)} AS summary FROM report ORDER BY size DESC, cluster_id LIMIT 10""", *_CLUSTERED)
check("cluster_report_sampled", "SELECT * FROM report ORDER BY size DESC, cluster_id LIMIT 20",
      f"c AS (SELECT {_LOC} AS loc, line, row_number() OVER (ORDER BY {_LOC}) - 1 AS i, count(*) OVER () AS n FROM ev WHERE is_error)",
      f"""texts AS (SELECT line AS txt, loc AS key FROM c WHERE n <= {K.CLUSTER_EMBED_LINES} OR i IN (SELECT CAST(floor(k * (n / {K.CLUSTER_EMBED_LINES}.0::DOUBLE)) AS BIGINT)
  FROM range({K.CLUSTER_EMBED_LINES}) r(k), (SELECT max(n) AS n FROM c)))""",
      *_vectors_of("texts", "x", "txt"), "v AS (SELECT 0 AS grp, key, txt, vec AS e, row_number() OVER (ORDER BY key) AS idx FROM embedded)",
      _running_means("v", K.CLUSTER_SIMILARITY),
      "members AS (SELECT cid AS cluster_id, key AS loc, txt AS line, e FROM rm JOIN v USING (grp, idx))", *_cluster_table("members"))
check("cluster_report_unsampled", "SELECT * FROM report ORDER BY size DESC, cluster_id LIMIT 20", *_CLUSTERED)



def _pair_vector(text: str) -> str:
    """Slots of hashed letter pairs, as the Python embedder of the query counts them."""
    return (
        f"list_transform(list_filter(range(1, length({text})), lambda i: regexp_matches(substr({text}, i, 2), '^[a-z][a-z]$')), "
        f"lambda i: (ascii(substr({text}, i, 1)) * 31 + ascii(substr({text}, i + 1, 1))) % 64)"
    )


check("cluster_report_prompt", "SELECT cluster_id, file, line_number FROM members",
      *_TEXTS, "lowered AS (SELECT *, lower(txt) AS low FROM texts)",
      f"slotted AS (SELECT *, {_pair_vector('low')} AS sl FROM lowered)",
      f"embedded AS (SELECT *, {_counts('sl')} AS e FROM slotted)",
      "topic AS (SELECT 'disk quota exceeded' AS low)", f"qs AS (SELECT {_pair_vector('low')} AS qsl FROM topic)",
      f"qv AS (SELECT {_counts('qsl')} AS q FROM qs)",
      "v AS (SELECT 0 AS grp, key, txt, e, row_number() OVER (ORDER BY key) AS idx FROM embedded, qv WHERE list_cosine_similarity(e, q) >= 0.3)",
      *_fixed_leaders("v", K.CLUSTER_SIMILARITY), _MEMBERS)

# --- files and streams ---

check("scan_numbering", "SELECT row_number() OVER (ORDER BY file_ord, line_number) - 1 AS ordinal, line FROM log_lines")
CHECKS["missing_files"] = """SELECT CAST(user_id AS BIGINT) AS user_id, file_ord FROM (
  SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS file_ord,
    count(*) FILTER (WHERE event_type = 'error' AND value >= 100) AS n
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id) WHERE n = 0"""
check("scan_totals", _totals())
check("stream_windows", f"SELECT window_start, total, errors FROM ({_windows(60)})")
check("stream_patterns", "SELECT pattern, cnt FROM counted WHERE cnt > 0", f"counted AS ({_COUNTS})")
check("stream_matches", f"SELECT event_id, line FROM ev WHERE {_HIT}")
check("tail_totals", f"""SELECT count(*) AS total_lines, count(*) FILTER (WHERE is_error) AS error_lines,
  {', '.join(f'count(*) FILTER (WHERE {t}_hit) AS {t}' for t in K.TAG_PATTERNS)} FROM ev""")
check("tail_time_filter", "SELECT part, line_number, line FROM kept",
      """parts AS (SELECT event_id // 4096 AS part, event_id % 4096 + 1 AS line_number, line, ts FROM ev)""",
      *_kept(_DAY, "parts", "part"))
check("tail_rotation", "SELECT count(*) + 2 * count(DISTINCT file) AS total_lines, count(*) FILTER (WHERE is_error) AS error_lines FROM ev")
check("tail_reset", """SELECT count(*) + count(*) FILTER (WHERE file_ord = first) AS total_lines,
  count(*) FILTER (WHERE is_error) + count(*) FILTER (WHERE is_error AND file_ord = first) AS error_lines FROM ev, (SELECT min(file_ord) AS first FROM ev)""")
check("tail_budget", "SELECT count(*) AS total_lines, count(*) FILTER (WHERE is_error) AS error_lines, true AS in_batches FROM ev")
check("stream_matches_context", f"SELECT CAST(file_ord AS INTEGER) AS file_ord, line_number, context FROM ev JOIN around ON file = af AND line_number = an WHERE {_HIT}",
      _around(2))
