import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import events, numbers, prompts, text, vectors


def column(spark, values, sql, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.out for r in rows.selectExpr("i", f"{sql} AS out").orderBy("i").collect()]


def test_event_time(spark):
    cases = {
        "2024-01-02 03:04:05 INFO x": dt.datetime(2024, 1, 2, 3, 4, 5),
        "x 2024-01-02T03:04:05.123Z": dt.datetime(2024, 1, 2, 3, 4, 5),
        "2024/01/02 03:04:05": dt.datetime(2024, 1, 2, 3, 4, 5),
        "2024/01/02T03:04:05": dt.datetime(2024, 1, 2, 3, 4, 5),
        "2024-13-02 03:04:05": None,
        "2024-02-30 03:04:05": None,
        "2024-01-02 24:00:00": None,
        "2024-01-02 23:59:60": None,
        "2024-02-30 03:04:05 then 2024/01/02 03:04:05": dt.datetime(2024, 1, 2, 3, 4, 5),
        "2024/01/02 03:04:05 then 2024-01-03 03:04:05": dt.datetime(2024, 1, 3, 3, 4, 5),
        "0000-01-02 03:04:05 then 2024-01-03 03:04:05": None,
        "0000-01-02 03:04:05 then 2024/01/03 03:04:05": dt.datetime(2024, 1, 3, 3, 4, 5),
        "2024-01-01 ERROR date only": None,
        "": None,
    }
    assert column(spark, cases, events.event_time("v")) == list(cases.values())


def expected_tags(line):
    return [
        name for name, pattern in K.TAG_PATTERNS.items()
        if re.search(pattern, line, 0 if name in K.CASE_SENSITIVE_TAGS else re.IGNORECASE)
    ]


def test_tags_match_python_patterns(spark):
    words = [
        "error", "Error", "errors", "time out", "timeout", "timed  out", "TIME\tOUT", "exception", "Traceback",
        "critical", "FATAL", "503", "5033", "x503", "499", "disk", "dıſK", "DİSK", "no space", "full", "fully",
        "inode", "quota", "ENOSPC", "i/o error", "read-only file system", "read only file system", "érror",
        "erroré", "time out", "ok", "_error_", "200", "5xx",
    ]
    rng = random.Random(3)
    lines = words + [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(300)]
    assert column(spark, lines, events.tags("v")) == [expected_tags(x) for x in lines]
    assert column(spark, lines, events.is_error("v")) == [bool(expected_tags(x)) for x in lines]


@pytest.mark.parametrize("minutes", [1, 5, 7, 45, 60, 90, 1440])
def test_bucket_start(spark, minutes):
    rng = random.Random(minutes)
    times = [dt.datetime(2024, 2, 28) + dt.timedelta(seconds=rng.randint(0, 300000)) for _ in range(100)]
    expected = [(t - dt.timedelta(minutes=t.minute % minutes)).replace(second=0) for t in times]
    assert column(spark, times, events.bucket_start("v", minutes), "v timestamp_ntz") == expected


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_round_exact_is_python_round(spark, digits):
    rng = random.Random(digits)
    values = [a / b for b in range(1, 130) for a in range(0, b + 1, 3)]
    values += [n / 800 for n in range(801)] + [n / 32 for n in range(-64, 65)] + [rng.uniform(-1, 1) for _ in range(300)]
    assert column(spark, values, numbers.round_exact("v", digits), "v double") == [round(v, digits) for v in values]


def test_round_ties_up(spark):
    assert column(spark, [12.25, 12.75, 0.05], numbers.round_exact("v", 1, "up"), "v double") == [12.3, 12.8, 0.1]


def test_ratio_of_nothing(spark):
    row = spark.range(1).selectExpr(
        f"{numbers.ratio('1L', '0L')} AS zero", f"{numbers.percent_text('1L', '0L')} AS text",
        f"{numbers.percent_text('1L', '3L')} AS third",
    ).first()
    assert tuple(row) == (0.0, "unknown", "33.33%")


def test_time_windows(spark):
    cases = {
        "show me database errors from the last 10 minutes": "0:10:00",
        "timeout past 2 hours": "2:00:00",
        "last 30s": "0:00:30",
        "since 5m ago": "0:05:00",
        "last 1 day": "1 day, 0:00:00",
        "Recent 49 HRS": "2 days, 1:00:00",
        "last 0 minutes": None,
        "last 10 months": None,
        "what are the timeout issues": None,
        "last 99999999999999999999 days": None,
        "": None,
    }
    sql = prompts.duration_text(f"({prompts.time_window_seconds('v')})")
    assert column(spark, cases, sql) == list(cases.values())


def test_strip_time_phrase(spark):
    cases = {
        "database errors for the last 10 minutes": "database errors",
        "disk full in the past 2h": "disk full",
        "timeout since 5m ago": "timeout",
        "pool exhausted": "pool exhausted",
    }
    assert column(spark, cases, prompts.strip_time_phrase("v")) == list(cases.values())


def test_specific_prompts(spark):
    cases = {
        "what are the main error categories": False, "cluster errors by root cause": False,
        "show me all failure types": False, "database timeout": True, "connection pool exhausted": True,
        "JWT token expired": True, "disk full errors": True, "last 5 minutes": False, "abcd": False, "": False,
    }
    assert column(spark, cases, prompts.is_specific_prompt("v")) == list(cases.values())


def test_resolved_prompt(spark):
    p = prompts.resolve_prompt(spark, "Database errors v1.2-rc database from the last 10 minutes")
    assert p.window_seconds == 600 and p.window_text == "0:10:00"
    assert p.terms == ("database", "v1.2-rc", "database")
    assert p.pattern == r"database|v1\.2\-rc|database"
    assert prompts.resolve_prompt(spark, "errors").pattern == K.FALLBACK_PATTERN
    assert prompts.resolve_prompt(spark, "errors last 0 minutes").search_text == "errors last 0 minutes"
    many = " ".join(f"word{i}" for i in range(300))
    assert len(prompts.resolve_prompt(spark, many).terms) == 300


def test_keyword_match_and_score(spark):
    lines = ["Database down", "DATABASE.v1x2 database", "", "   ", "a b pool", "Kernel", "x" * 1020 + " database"]
    terms, pattern = ("database", "kernel"), "database|kernel"
    rx = re.compile(pattern, re.I)
    assert column(spark, lines, text.keyword_match("v", terms, pattern)) == [bool(rx.search(x)) for x in lines]
    expected = [round(len(rx.findall(x)) / max(len(x.split()), 1), 4) for x in lines]
    assert column(spark, lines, text.keyword_score("v", f"'{pattern}'")) == expected
    many = tuple(f"zz{i}" for i in range(40)) + ("kernel",)
    assert column(spark, lines, text.keyword_match("v", many, "")) == [False] * 5 + [True, False]


def test_signature(spark):
    def plain(line):
        line = re.sub(r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}\s*", "", line)
        line = re.sub(r"^(ERROR|WARN|CRITICAL|FATAL|INFO|DEBUG)\s*", "", line, flags=re.I)
        for _ in range(2):
            line = re.sub(r"^\[[\w\-]+\]\s*", "", line)
        return line.strip()[:150]

    lines = [
        "2024-01-01 10:00:00 ERROR [a-b] [t1] [kept] boom  ", "2024/01/01T10:00:00 warning x", "error: y", "  z",
        "[a][b]c", "[a b] c", "INFO", "", "2024-01-01 10:00:00 " + "m" * 200, " x ", "2024-01-01 ERROR q",
    ]
    assert column(spark, lines, text.error_signature("v", 150)) == [plain(x) for x in lines]


def test_label_tokens_and_label(spark):
    lines = ["ERROR Database db-primary database 2024 x1 timeout.after", "a bc 123", ""]
    assert column(spark, lines, text.label_tokens("v")) == [["database", "db-primary", "timeout.after"], [], []]
    assert column(spark, [["a", "b", "c", "d"], []], text.cluster_label("v"), "v array<string>") == ["A B C", "UNKNOWN"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0, 9.0], [3.0, 4.0])],
                                 "a array<double>, b array<double>")
    got = [r.c for r in rows.selectExpr(f"{vectors.cosine('a', 'b')} AS c").collect()]
    assert got == pytest.approx([0.5 ** 0.5, 0.0, 25 / (106 ** 0.5 * 5)])


def test_mask_round_trip(spark):
    got = column(spark, ["ERROR disk full", "fine"], f"struct({events.tag_mask('v')} AS m, {events.tags('v')} AS t)")
    assert [(g.m, g.t) for g in got] == [(33, ["error", "disk"]), (0, [])]
    assert spark.range(1).select(F.expr(events.mask_names("33"))).first()[0] == ["error", "disk"]
