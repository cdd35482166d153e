import json

import pytest

from logharbor.operators import health, search, signatures
from logharbor.operators.embedding import HashedTokens
from logharbor.operators.timefilter import Bounds
from logharbor.plans import reports

APP = [
    "2024-01-01T10:00:00 INFO  service started",
    "2024-01-01T10:01:00 ERROR database connection failed",
    "2024-01-01T10:02:00 ERROR request timeout",
    "2024-01-01T10:03:00 INFO  retrying connection",
]


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_app_log(make_lines):
    r = reports.analyze(make_lines(APP), 5, 0.20, max_samples=10)
    assert rows(r.totals) == [(4, 2, 0.5)]
    assert rows(r.pattern_counts) == [("error", 2, 1), ("timeout", 1, 2)]
    high = r.high_windows.collect()
    assert [(str(w.window_start), w.window_minutes, w.total, w.errors, w.error_rate) for w in high] == [
        ("2024-01-01 10:00:00", 5, 4, 2, 0.5)
    ]
    assert [x.line for x in r.error_lines.collect()] == APP[1:3]
    assert not r.prompt_filtered


@pytest.mark.parametrize("i", range(3))
def test_two_line_files(make_lines, i):
    lines = make_lines([f"2024-01-01T10:00:00 INFO thread {i} started", f"2024-01-01T10:01:00 ERROR thread {i} failed"])
    assert rows(reports.analyze(lines).totals) == [(2, 1, 0.5)]


def test_no_lines(make_lines):
    r = reports.analyze(make_lines([]))
    assert rows(r.totals) == [(0, 0, 0.0)]
    assert r.pattern_counts.count() == r.high_windows.count() == r.error_lines.count() == 0
    assert json.loads(reports.health_payload(r).first().payload)["total_lines"] == 0


def test_ties_go_to_the_first_line_then_tag_order(make_lines):
    lines = make_lines(["disk", "fatal timeout"], ["error"])
    counts = health.pattern_counts(health.bucket_summary(lines))
    assert [r.pattern for r in counts.orderBy("rank").collect()] == ["disk", "timeout", "critical", "error"]


def test_threshold_uses_the_unrounded_rate(make_lines):
    file = [f"2024-01-01 10:00:{i % 60:02d} " + ("error" if i < 1 else "ok") for i in range(3)]
    summary = health.bucket_summary(make_lines(file))
    assert health.high_error_windows(summary, 5, 0.3333).count() == 1
    assert health.high_error_windows(summary, 5, 0.33334).count() == 0
    assert health.error_windows(summary).first().error_rate == 0.3333


def test_undated_lines_count_in_totals_not_in_windows(make_lines):
    r = reports.analyze(make_lines(["error", *APP]), bounds=Bounds("2024-01-01T10:02:00", None))
    assert rows(r.totals) == [(3, 2, 0.6667)]
    assert [(w.total, w.errors) for w in r.windows.collect()] == [(2, 1)]


@pytest.mark.parametrize("bad", [dict(bucket_minutes=0), dict(threshold=1.5), dict(threshold=-0.1)])
def test_bad_parameters(make_lines, bad):
    with pytest.raises(ValueError):
        reports.analyze(make_lines(APP), **bad)


def test_day_bounds():
    assert reports.day_bounds("2024-01-01", None, "2024-02-03") == Bounds("2024-01-01T00:00:00", "2024-02-03T23:59:59")
    assert reports.day_bounds(None, "2024-01-01", "2024-02-03") == Bounds(None, "2024-01-01T23:59:59")


def test_prompt_filters_samples_but_not_counts(make_lines):
    r = reports.analyze(make_lines(APP), prompt="database connection", embedder=HashedTokens())
    assert r.prompt_filtered and rows(r.totals) == [(4, 2, 0.5)]
    assert [x.line for x in r.error_lines.collect()] == [APP[1]]


def test_health_document(make_lines):
    doc = json.loads(reports.health_payload(reports.analyze(make_lines(APP))).first().payload)
    assert doc == {
        "total_lines": 4, "error_lines": 2, "error_rate": 0.5, "pattern_counts": {"error": 2, "timeout": 1},
        "high_error_windows": [{"window_start": "2024-01-01 10:00:00", "window_minutes": 5, "total": 4, "errors": 2,
                                "error_rate": 0.5}],
        "sample_error_lines": APP[1:3],
    }


def test_signatures(make_lines):
    lines = make_lines(["2024-01-01 10:00:00 ERROR [x] boom", "2024-01-01 11:00:00 ERROR [y] boom", "ok"], ["error: z"])
    got = {r.signature: (r.cnt, str(r.first_seen), str(r.last_seen)) for r in signatures.signature_rollup(lines).collect()}
    # the level is part of the line, so both boom lines carry the tag; only ': z' remains of the last
    assert got == {"boom": (2, "2024-01-01 10:00:00", "2024-01-01 11:00:00"), ": z": (1, "None", "None")}


def test_explanations_with_and_without_model(make_lines):
    lines = make_lines(APP)
    assert {r.explanation for r in reports.explain(lines).collect()} == {
        "No text model was given."
    }
    shouted = reports.explain(lines, lambda texts: [t.upper() for t in texts])
    assert {r.explanation for r in shouted.collect()} == {"DATABASE CONNECTION FAILED", "REQUEST TIMEOUT"}

    def broken(texts):
        raise RuntimeError("no model")

    assert {r.explanation for r in reports.explain(lines, broken).collect()} == {"no text from the model: no model"}


def test_one_bad_text_spoils_its_own_row_only(spark):
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("refused")
        return [t.upper() for t in texts] if len(texts) < 4 else []

    rows = spark.createDataFrame([(t,) for t in [*"abcdefg", "bad"]], "t string").coalesce(1)
    got = {r.t: r.out for r in reports.infer_texts(rows, "t", model, "out", batch=5).collect()}
    assert got == {**{t: t.upper() for t in "abcdefg"}, "bad": "no text from the model: refused"}


def test_top_keywords_break_ties_by_first_encounter(make_lines):
    from logharbor.operators.positions import with_position

    lines = with_position(make_lines(["zeta alpha alpha", "alpha beta gamma delta omega", "beta zeta"]))
    got = signatures.top_keywords(lines, "file").orderBy("rank").collect()
    assert [(r.keyword, r.cnt) for r in got] == [("zeta", 2), ("alpha", 2), ("beta", 2), ("gamma", 1), ("delta", 1)]


def test_reports_are_written(make_lines, tmp_path, spark):
    r = reports.analyze(make_lines(APP))
    reports.write_report(r.windows, str(tmp_path / "w"))
    reports.write_report(r.totals, str(tmp_path / "t"), "json")
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    assert json.loads(next((tmp_path / "t").glob("part-*")).read_text()) == {
        "total_lines": 4, "error_lines": 2, "error_rate": 0.5
    }
    with pytest.raises(ValueError):
        reports.write_report(r.totals, str(tmp_path / "x"), "csv")


def test_match_stats(make_lines):
    lines = make_lines(APP)
    stats = search.match_stats(health.error_lines(lines), lines)
    assert rows(stats) == [(2, 4, "50.00%")]
    none = make_lines([])
    assert rows(search.match_stats(none, none)) == [(0, 0, "unknown")]
