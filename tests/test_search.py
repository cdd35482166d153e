import json
import re

import pytest

from logharbor import constants as K
from logharbor.functions.prompts import resolve_prompt
from logharbor.operators import context, manyprompts, positions, search
from logharbor.operators.embedding import FunctionEmbedder, HashedTokens, StoredVectors, embed_one, embed_texts
from logharbor.operators.positions import with_position
from logharbor.plans import reports
from logharbor.runtime import new_folder
from logharbor.sources import logfiles

SEARCH = [
    "2024-01-01T10:00:00 INFO  starting",
    "2024-01-01T10:01:00 ERROR database timeout exceeded",
    "2024-01-01T10:02:00 ERROR database timeout exceeded",
    "2024-01-01T10:03:00 INFO  recovered",
]
SHARED = ["2024-01-01T10:00:00 ERROR authentication failed"] * 2 + ["2024-01-01T10:01:00 INFO user logged in"]


def test_search_log(make_lines):
    got = reports.search(make_lines(SEARCH), "database timeout", max_matches=50, context_lines=0).collect()
    assert [(r.line_number, r.line, r.context, r.similarity) for r in got] == [
        (2, SEARCH[1], SEARCH[1], 0.4), (3, SEARCH[2], SEARCH[2], 0.4)
    ]


def test_shared_log(make_lines):
    assert reports.search(make_lines(SHARED), "authentication failed").count() >= 2


def test_every_error_line_is_a_match(make_lines):
    got = reports.search(make_lines(SEARCH), "recovered", context_lines=1).collect()
    assert [(r.line_number, r.similarity) for r in got] == [(4, 0.3333), (2, 0.0), (3, 0.0)]
    assert got[0].context == "\n".join(SEARCH[2:4])


def test_blank_prompt(make_lines):
    with pytest.raises(ValueError):
        reports.search(make_lines(SEARCH), "  ")


def brute(files, pattern, limit, c, rank_first=False):
    rx = re.compile(pattern, re.I)
    tags = [re.compile(p, 0 if t in K.CASE_SENSITIVE_TAGS else re.I) for t, p in K.TAG_PATTERNS.items()]
    out = []
    for o, file in enumerate(files):
        for i, line in enumerate(file):
            if rx.search(line) or any(t.search(line) for t in tags):
                shown = line[:1024]
                score = round(len(rx.findall(line)) / max(len(line.split()), 1), 4)
                out.append((f"f{o}.log", i + 1, shown, "\n".join(file[max(0, i - c):i + c + 1])[:2048], score))
    if not rank_first:
        out = out[:limit]
    return sorted(out, key=lambda m: -m[4])[:limit]


@pytest.mark.parametrize("rank_first", [False, True])
@pytest.mark.parametrize("limit,c", [(3, 0), (10, 2), (1000, 40)])
def test_keyword_search_against_loop(make_lines, limit, c, rank_first):
    files = [
        [f"row {i} " + ("pool " * (i % 4)) + ("error " if i % 5 == 0 else "") + "y" * (i * 40) for i in range(50)],
        ["pool", "", "fatal pool pool"],
        ["nothing"],
    ]
    got = search.keyword_search(make_lines(*files), "pool", limit, c, rank_first=rank_first, chunk_bits=3)
    assert [tuple(r) for r in got.collect()] == brute(files, "pool", limit, c, rank_first)


def test_context_stays_within_the_file(make_lines):
    lines = with_position(make_lines(["a", "b"], ["c", "d"]))
    got = context.add_context(lines.select("file", "pos"), lines, 1)
    want = ["a\nb", "a\nb", "c\nd", "c\nd"]
    assert [r.context for r in got.orderBy("pos").collect()] == want


def test_relative_window_in_the_prompt(make_lines):
    got = reports.search(make_lines(SEARCH), "timeout in the last 1 minute", context_lines=0).collect()
    assert [r.line_number for r in got] == [3]


def test_semantic_search_with_a_python_embedder(make_lines):
    def vowels(texts):
        return [[float(t.lower().count(v)) for v in "aeiou"] for t in texts]

    lines = make_lines(SEARCH)
    got = reports.search(lines, "database timeout", embedder=FunctionEmbedder(vowels, batch=2), prompt_threshold=0.0)
    q = vowels(["database timeout"])[0]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    assert [(r.line_number, r.similarity) for r in got.collect()] == [
        (n + 1, round(cos(q, vowels([SEARCH[n]])[0]), 4)) for n in (1, 2)
    ]


def test_fallback_to_keywords_when_the_embedder_fails(make_lines):
    def down(texts):
        raise ConnectionError("refused")

    got = reports.search_report(make_lines(SEARCH), "database timeout last 1h", embedder=FunctionEmbedder(down))
    assert (got.search_mode, got.time_window) == ("regex", "1:00:00")
    assert [r.line_number for r in got.matches.collect()] == [2, 3]
    health = reports.analyze(make_lines(SEARCH), prompt="timeout", embedder=FunctionEmbedder(down), max_samples=1)
    assert not health.prompt_filtered and health.error_lines.count() == 1


def test_embedder_is_called_with_distinct_texts_in_batches(spark):
    def check(texts):
        assert len(texts) <= 3 and len(set(texts)) == len(texts)
        return [[float(len(t))] for t in texts]

    frame = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(50)], "i int, line string").coalesce(1)
    got = embed_texts(frame, FunctionEmbedder(check, batch=3)).orderBy("i").collect()
    assert [r.embedding for r in got] == [[float(i % 7)] for i in range(50)]


def test_hashed_tokens_depend_on_tokens_only(spark):
    a = embed_one(spark, HashedTokens(16), "Database DOWN 12")
    assert a == embed_one(spark, HashedTokens(16), "down, database") and sum(a) == 2.0


def test_search_document_names_question_and_counts(make_lines):
    import json

    lines = make_lines(SEARCH)
    found = reports.search(lines, "it's \"database\"", context_lines=0)
    doc = json.loads(reports.search_payload(found, lines, "it's \"database\"").first().payload)
    assert doc == {"question": "it's \"database\"", "total_lines": 4, "total_matches": 2, "percent": "50.00%",
                   "matching_lines": SEARCH[1:3]}


def test_payload_ties_follow_the_file_list(spark):
    lines = spark.createDataFrame(
        [("z.log", 0, 0, "pool error z"), ("a.log", 1, 0, "pool error a")], "file string, file_ord int, line_no bigint, line string"
    )
    matches = reports.search(lines, "pool", context_lines=0)
    payload = json.loads(reports.search_payload(matches, lines, "pool").first().payload)
    assert payload["matching_lines"] == ["pool error z", "pool error a"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [True, False])
def test_position_masks(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(positions, "small_side", lambda df: (df, False))
    rows = spark.range(5000).withColumnRenamed("id", "pos")
    want = {0, 63, 64, 65, 127, 1000, 4095, 4096, 4999}
    asked = spark.createDataFrame([(p,) for p in (*want, 63, 70_000)], "pos bigint")
    for bits in (1, 8, 18):
        got = positions.at_positions(rows, positions.position_masks(asked), bits)
        assert sorted(r.pos for r in got.collect()) == sorted(want)


def test_context_shuffles_only_lines_near_a_match(spark, make_lines):
    lines = with_position(make_lines([f"row {i}" for i in range(500)]))
    lines.write.parquet(path := new_folder(spark, "context-test"))
    lines = spark.read.parquet(path)
    masks = positions.position_masks(lines.where("pos % 100 = 7").select("pos"))
    assert "hashpartitioning" not in plan_of(positions.at_positions(lines, masks))
    got = context.add_context(lines.where("pos % 100 = 7"), lines, 1).orderBy("pos").collect()
    assert [r.context for r in got] == [f"row {i - 1}\nrow {i}\nrow {i + 1}" for i in range(7, 500, 100)]


def test_first_matches_read_few_files(spark, make_lines, monkeypatch):
    files = [[f"row {i} pool" if i % 3 == 0 else f"row {i}" for i in range(40)] for _ in range(6)]
    path = new_folder(spark, "landed-test")
    logfiles.land(make_lines(*files).repartitionByRange(24, "file_ord", "line_no").sortWithinPartitions("file_ord", "line_no"), path)
    assert logfiles.landed_zones(spark, path).count() > 12
    prompt = resolve_prompt(spark, "pool")
    want = [(o, i) for o, f in enumerate(files) for i, x in enumerate(f) if "pool" in x]
    for n in (1, 7, 20, 60, 1000):
        got = search.first_matches_landed(spark, path, prompt, n)
        assert [(r.file_ord, r.line_no) for r in got.collect()] == want[:n]
        if n <= 7:
            assert len(got.inputFiles()) <= 4
    dated = search.first_matches_landed(spark, path, resolve_prompt(spark, "pool in the last 1 hour"), 5)
    assert [(r.file_ord, r.line_no) for r in dated.collect()] == want[:5]
    logfiles.land(make_lines([]), empty := new_folder(spark, "landed-test"))
    assert search.first_matches_landed(spark, empty, prompt, 5).count() == 0


def test_many_prompts_against_loop(spark, make_lines):
    files = [["pool exhausted", "ERROR pool", "Kelvin \u212a-box x.y", "", "po", "fatality 599x"], ["swimming POOL", None, "k-box", "restimeouts"]]
    texts = ["pool trouble", "k-box", "x.y zzz", "show errors", "", None, "pool pool in the last 2 hours", "absent term", "swimming box"]
    prompts = spark.createDataFrame(list(enumerate(texts)), "prompt_id int, prompt string")
    lines = make_lines(*files)
    got = {r.prompt_id: r.matches for r in manyprompts.count_matches(lines, prompts).collect()}
    for i, text in enumerate(texts):
        asked = resolve_prompt(spark, text or "")
        assert got[i] == search.matching_lines(with_position(lines), asked).drop("file").where(search.is_match(lines, asked)).count(), text
    assert "CartesianProduct" not in plan_of(manyprompts.count_matches(lines, prompts))
    assert manyprompts.count_matches(lines, prompts.limit(0)).count() == 0
    none = {r.prompt_id: r.matches for r in manyprompts.count_matches(lines.limit(0), prompts).collect()}
    assert none == dict.fromkeys(range(len(texts)), 0)


def test_each_text_is_embedded_once(spark, make_lines, tmp_path):
    """Over partitions and over two runs, by a search that ranks with the embedder, and by a report."""
    log = tmp_path / "asked.txt"

    def vowels(texts):
        with open(log, "a") as fh:
            fh.write("".join(f"{t}\n" for t in texts))
        return [[float(t.lower().count(v)) + 0.1 for v in "aeiou"] for t in texts]

    stored = StoredVectors(FunctionEmbedder(vowels), str(tmp_path / "vectors"))
    plain = FunctionEmbedder(lambda texts: [[float(t.lower().count(v)) + 0.1 for v in "aeiou"] for t in texts])
    files = [f"ERROR pool {'abc'[i % 3]} exhausted" for i in range(60)] + ["fatal disk", "", None]
    lines = make_lines(files[:40], files[40:]).repartition(7)
    for more in ([], ["ERROR pool new one"]):
        rows = lines.unionByName(make_lines(more)) if more else lines
        got = embed_texts(rows, stored).select("line", "embedding").collect()
        want = {r.line: r.embedding for r in embed_texts(rows, plain).collect()}
        assert len(got) == 63 + len(more) and all(r.embedding == pytest.approx(want[r.line]) for r in got)
    ranked = search.keyword_search(make_lines(files), "pool", 10, 0, embedder=stored)
    assert [tuple(r) for r in ranked.collect()] == [tuple(r) for r in search.keyword_search(make_lines(files), "pool", 10, 0, embedder=plain).collect()]
    asked = log.read_text().split("\n")[:-1]
    assert sorted(asked) == sorted(set(asked)) and set(asked) >= {x or "" for x in files}
