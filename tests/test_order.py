"""Ordinals, first rows, sampling and time filters against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logharbor.operators import positions, sampling, timefilter
from logharbor.operators.timefilter import Bounds
from logharbor.runtime import new_folder

BASE = dt.datetime(2024, 1, 1)


def some_lines(seed, files=3, n=60, dated=0.5):
    rng = random.Random(seed)
    out = []
    for _ in range(files):
        file = []
        for _ in range(rng.randint(0, n)):
            if rng.random() < dated:
                at = BASE + dt.timedelta(minutes=rng.randint(0, 2880))
                file.append(f"{at:%Y-%m-%d %H:%M:%S} INFO x")
            else:
                file.append("   at frame")
        out.append(file)
    return out


def time_of(line):
    return dt.datetime.strptime(line[:19], "%Y-%m-%d %H:%M:%S") if line[:1].isdigit() else None


def kept_by_loop(file, accept):
    kept = []
    for i, line in enumerate(file):
        ts = time_of(line)
        if ts is not None:
            if accept(ts):
                kept.append(i)
        elif kept and i - kept[-1] <= 5:
            kept.append(i)
    return kept


def numbers(frame):
    return sorted((r.file_ord, r.line_no) for r in frame.select("file_ord", "line_no").collect())


def expected(files, accept):
    return [(o, i) for o, f in enumerate(files) for i in kept_by_loop(f, accept)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bits", [1, 3, 18])
def test_date_range_with_continuations(make_lines, seed, bits):
    files = some_lines(seed, dated=0.15 + 0.2 * seed)
    low, high = BASE + dt.timedelta(hours=10), BASE + dt.timedelta(hours=30)
    got = timefilter.date_range_filter(make_lines(*files), low.isoformat(), high.isoformat(), bits)
    assert numbers(got) == expected(files, lambda t: low <= t <= high)


def test_undated_text_is_not_shuffled(spark, make_lines):
    make_lines(*some_lines(3)).write.parquet(path := new_folder(spark, "order-test"))
    kept = timefilter.date_range_filter(spark.read.parquet(path), "2024-01-01T10:00:00", "2024-01-02T06:00:00")
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hours", [(8, 10), (22, 4), (-5, 2), (20, 99)])
def test_hour_range(make_lines, hours):
    files = some_lines(9)
    low, high = (max(0, min(23, h)) for h in hours)
    accept = lambda t: low <= t.hour <= high if low <= high else t.hour >= low or t.hour <= high
    got = timefilter.hour_range_filter(make_lines(*files), *hours, chunk_bits=2)
    assert numbers(got) == expected(files, accept)


def test_relative_window_per_file(make_lines):
    files = [*some_lines(5), ["no time", "at all"], []]
    want = []
    for o, file in enumerate(files):
        times = [t for t in map(time_of, file) if t]
        if not times:
            want += [(o, i) for i in range(len(file))]
            continue
        now = times[-1]
        want += [(o, i) for i in kept_by_loop(file, lambda t: now - dt.timedelta(hours=6) <= t <= now)]
    assert numbers(timefilter.relative_window_filter(make_lines(*files), 6 * 3600, chunk_bits=2)) == want


def test_precedence(make_lines):
    files = some_lines(6)
    lines = make_lines(*files)
    both = timefilter.apply_time_filter(lines, Bounds("2024-01-02", None, 1, 5), 60)
    assert numbers(both) == expected(files, lambda t: t >= BASE + dt.timedelta(days=1) and 1 <= t.hour <= 5)
    # one hour bound alone is ignored, and so is a date that cannot be read
    assert timefilter.apply_time_filter(lines, Bounds("soon", None, 1, None), None).count() == lines.count()


def test_health_filter_keeps_undated_and_does_not_clamp(make_lines):
    files = some_lines(7)
    got = timefilter.health_filter(make_lines(*files), Bounds(hour_min=-5, hour_max=2))
    want = [(o, i) for o, f in enumerate(files) for i, x in enumerate(f) if time_of(x) is None or time_of(x).hour <= 2]
    assert numbers(got) == want


@pytest.mark.parametrize("bits", [1, 4, 18])
def test_ordinals(make_lines, bits):
    files = some_lines(11)
    lines = positions.with_position(make_lines(*files)).where("line_no % 3 <> 1")
    want = sorted((o, i) for o, f in enumerate(files) for i in range(len(f)) if i % 3 != 1)
    got = positions.with_ordinal(lines, chunk_bits=bits).orderBy("ordinal").collect()
    assert [(r.file_ord, r.line_no) for r in got] == want
    assert [r.ordinal for r in got] == list(range(len(want)))
    per = positions.with_ordinal(lines, per="file_ord", chunk_bits=bits).orderBy("pos").collect()
    assert [r.ordinal for r in per] == [sum(1 for x in want[:k] if x[0] == want[k][0]) for k in range(len(want))]


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_first_rows(make_lines, n):
    files = some_lines(12)
    lines = positions.with_position(make_lines(*files))
    want = sorted((o, i) for o, f in enumerate(files) for i in range(len(f)))[:n]
    assert numbers(positions.first_rows(lines, n, 2)) == want


@pytest.mark.parametrize("k", [1, 2, 7, 30, 59, 5000])
@pytest.mark.parametrize("bits", [1, 3, 18])
def test_even_sample(make_lines, k, bits):
    files = some_lines(13)
    lines = positions.with_position(make_lines(*files))
    rows = sorted((o, i) for o, f in enumerate(files) for i in range(len(f)))
    step = len(rows) / k
    want = [rows[int(i * step)] for i in range(k)] if len(rows) > k else rows
    assert numbers(sampling.even_sample(lines, k, bits)) == want


def test_even_sample_of_nothing(make_lines):
    lines = positions.with_position(make_lines(["a"])).where(F.lit(False))
    assert sampling.even_sample(lines, 5).count() == 0


def test_sampling_scans_once_for_counts_and_ranks(make_lines):
    lines = positions.with_position(make_lines(["a", "b"]))
    frame = sampling.even_positions(lines, 1)
    frame.collect()
    assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("file_ord,line_no,fits", [((1 << 23) - 1, (1 << 40) - 1, True), (1 << 23, 0, False), (0, 1 << 40, False)])
def test_positions_that_do_not_fit_stop_the_job(spark, file_ord, line_no, fits):
    rows = positions.with_position(spark.createDataFrame([(file_ord, line_no)], "file_ord int, line_no bigint"))
    if fits:
        assert rows.first().pos == (file_ord << 40) + line_no
    else:
        with pytest.raises(Exception, match="too large for a position"):
            rows.collect()
