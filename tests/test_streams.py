import json

import pytest

from logharbor.operators import timefilter
from logharbor.functions.prompts import resolve_prompt
from logharbor.sources import tail
from logharbor.streaming import live


def reader(paths, split=1 << 20):
    return tail.TailReader({"paths": json.dumps([str(p) for p in paths]), "splitBytes": str(split)})


def drain(source, start):
    """Rows of the ranges from ``start`` to now, and the new offset, as a restarted query sees them."""
    end = json.loads(json.dumps(source.latestOffset()))
    rows = []
    for split in source.partitions(start, end):
        for batch in source.read(split):
            rows += batch.to_pylist()
    return rows, end


def test_new_lines_only_and_whole_lines_only(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"one\ntwo\r\npart")
    rows, offset = drain(reader([path]), {})
    assert [(r["offset"], r["line"]) for r in rows] == [(0, "one"), (4, "two")]
    assert drain(reader([path]), offset)[0] == []
    with open(path, "ab") as fh:
        fh.write(b"ial\nfo\xffur\n")
    rows, offset = drain(reader([path]), offset)
    assert [(r["offset"], r["line"]) for r in rows] == [(9, "partial"), (17, "four")]


def test_shrunk_and_replaced_files_start_again(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("2024-01-01 a\nb\nc\n")
    rows, offset = drain(reader([path]), {})
    first = rows[0]["generation"]
    path.write_text("2024-01-02 x\n")
    rows, offset = drain(reader([path]), offset)
    assert [r["line"] for r in rows] == ["2024-01-02 x"] and rows[0]["generation"] != first
    path.write_text("2024-01-03 a longer file that was put in its place\n")
    rows, offset = drain(reader([path]), offset)
    assert [r["line"] for r in rows] == ["2024-01-03 a longer file that was put in its place"]
    path.write_text("2024-01-03 a longer file that was put in its place\nmore\n")
    assert [r["line"] for r in drain(reader([path]), offset)[0]] == ["more"]


def test_an_emptied_file_begins_anew_with_the_same_first_line(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("banner\none\n")
    source = reader([path])
    rows, offset = drain(source, {})
    path.write_text("")
    rows, offset = drain(source, offset)
    assert rows == []
    path.write_text("banner\ntwo\nthree, longer than before\n")
    rows, offset = drain(source, offset)
    assert [r["line"] for r in rows] == ["banner", "two", "three, longer than before"]


def test_a_longer_file_with_the_same_first_line_in_its_place(tmp_path):
    path, other = tmp_path / "a.log", tmp_path / "b.log"
    path.write_text("banner\none\n")
    rows, offset = drain(reader([path]), {})
    other.write_text("banner\ntwo\nthree, longer than before\n")
    other.replace(path)
    new, _ = drain(reader([path]), offset)
    assert [r["line"] for r in new] == ["banner", "two", "three, longer than before"]
    assert new[0]["generation"] != rows[0]["generation"]


def test_a_file_cut_after_planning_ends_the_range(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\nthree\n")
    source = reader([path], 5)
    splits = source.partitions({}, source.latestOffset())
    path.write_text("one\n")
    assert [r["line"] for s in splits for b in source.read(s) for r in b.to_pylist()] == ["one"]


def test_absent_files_are_picked_up_later(tmp_path):
    paths = [tmp_path / "a.log", tmp_path / "b.log"]
    paths[0].write_text("x\n")
    source = reader(paths)
    rows, offset = drain(source, {})
    assert [(r["file_ord"], r["line"]) for r in rows] == [(0, "x")]
    paths[1].write_text("y\n")
    paths[0].unlink()
    rows, offset = drain(source, offset)
    assert [(r["file_ord"], r["line"]) for r in rows] == [(1, "y")]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 16, 1000])
def test_splits_read_every_line_once(tmp_path, split):
    path = tmp_path / "a.log"
    body = "".join(f"{'x' * (i % 9)}\n" for i in range(60)) + "y\rz\n"
    path.write_text(body, newline="")
    source = reader([path], split)
    rows, _ = drain(source, {})
    assert [r["line"] for r in sorted(rows, key=lambda r: r["offset"])] == body.replace("\r", "\n").split("\n")[:-1]
    assert len({r["offset"] for r in rows}) == len(rows)


def test_long_lines_and_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "READ_BYTES", 10)
    path = tmp_path / "a.log"
    body = "a\n" + "b" * 35 + "\n\n" + "c" * 9 + "\nd\n"
    path.write_text(body)
    for split in (4, 20, 100):
        rows, _ = drain(reader([path], split), {})
        assert [r["line"] for r in sorted(rows, key=lambda r: r["offset"])] == body.split("\n")[:-1]


def test_tail_stream_totals_over_two_runs(spark, tmp_path):
    path, state = tmp_path / "a.log", str(tmp_path / "state")
    path.write_text("2024-01-01 10:00:00 ERROR disk full\nok\n")
    result = live.live_totals(tail.tail_lines(spark, [str(path)]))
    first = live.run_to_table(result, "complete", state, str(tmp_path / "out")).first()
    assert (first.total_lines, first.error_lines, first.disk) == (2, 1, 1)
    with open(path, "a") as fh:
        fh.write("fatal\n")
    result = live.live_totals(tail.tail_lines(spark, [str(path)]))
    again = live.run_to_table(result, "complete", state, str(tmp_path / "out")).first()
    assert (again.total_lines, again.error_lines, again.critical) == (3, 2, 1)
    # a fresh checkpoint reads everything again
    reset = live.run_to_table(live.live_totals(tail.tail_lines(spark, [str(path)])), "complete").first()
    assert reset.total_lines == 3
    with pytest.raises(ValueError):
        tail.tail_lines(spark, [" "])


def batches(tmp_path, n=3):
    files = [[], []]
    for i in range(90):
        f = files[i % 2]
        f.append(f"2024-01-0{1 + i // 30} 10:{i % 60:02d}:00 INFO n{i}" if i % 4 == 0 or i % 7 == 0 else f"  at frame {i}")
    return files, [[f[k * len(f) // n:(k + 1) * len(f) // n] for f in files] for k in range(n)]


def test_live_time_filter_equals_batch(spark, make_lines, tmp_path):
    files, parts = batches(tmp_path)
    paths = [str(tmp_path / "f0.log"), str(tmp_path / "f1.log")]
    bounds = ("2024-01-01T10:20:00", "2024-01-02T10:45:00")
    for part in parts:
        for path, lines in zip(paths, part):
            with open(path, "a") as fh:
                fh.write("".join(x + "\n" for x in lines))
        kept = live.run_live_filter(
            tail.tail_lines(spark, paths, split_bytes=100), timefilter.in_dates("ts", *bounds),
            str(tmp_path / "out"), str(tmp_path / "carry"), str(tmp_path / "state"), chunk_bits=3,
        )
    want = timefilter.date_range_filter(make_lines(*files), *bounds)
    assert sorted((r.file_ord, r.line_no, r.line) for r in kept.collect()) == sorted(
        (r.file_ord, r.line_no, r.line) for r in want.collect()
    )


def test_live_filter_starts_again_after_rotation(spark, tmp_path):
    path = str(tmp_path / "f.log")
    run = lambda: live.run_live_filter(
        tail.tail_lines(spark, [path]), "true", str(tmp_path / "out"), str(tmp_path / "carry"), str(tmp_path / "state")
    )
    with open(path, "w") as fh:
        fh.write("2024-01-01 10:00:00 a\n  b\n")
    run()
    with open(path, "w") as fh:
        fh.write("  c\n2024-01-02 10:00:00 d\n")
    got = run().collect()
    assert sorted((r.line_no, r.line) for r in got) == [(0, "2024-01-01 10:00:00 a"), (1, "  b"), (1, "2024-01-02 10:00:00 d")]


def test_live_filter_numbers_anew_after_rotation_with_the_same_first_line(spark, tmp_path):
    path = str(tmp_path / "f.log")
    run = lambda: live.run_live_filter(
        tail.tail_lines(spark, [path]), "true", str(tmp_path / "out"), str(tmp_path / "carry"), str(tmp_path / "state")
    )
    with open(path, "w") as fh:
        fh.write("banner\n2024-01-01 10:00:00 a long enough line\n")
    run()
    with open(path, "w") as fh:
        fh.write("banner\n2024-01-02 10:00:00 b\n")
    run()
    with open(path, "a") as fh:
        fh.write("  c\n")
    got = run().collect()
    assert sorted((r.line_no, r.line) for r in got) == [
        (1, "2024-01-01 10:00:00 a long enough line"), (1, "2024-01-02 10:00:00 b"), (2, "  c")
    ]


def test_live_matches_and_windows(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("2024-01-01 10:01:00 ERROR x\n2024-01-01 10:02:00 pool\n2024-01-01 10:09:00 ok\nundated error\n")
    stream = tail.tail_lines(spark, [str(path)])
    found = live.run_to_table(live.live_matches(stream, resolve_prompt(spark, "pool")).select("line"), "append")
    assert sorted(r.line[-4:] for r in found.collect()) == ["OR x", "pool", "rror"]
    windows = live.run_to_table(live.live_windows(tail.tail_lines(spark, [str(path)]), 5), "complete")
    assert sorted((str(r.window_start), r.total, r.errors) for r in windows.collect()) == [
        ("2024-01-01 10:00:00", 2, 1), ("2024-01-01 10:05:00", 1, 0)
    ]
    patterns = live.run_to_table(live.live_pattern_counts(tail.tail_lines(spark, [str(path)])), "complete")
    assert [(r.pattern, r.cnt) for r in patterns.collect()] == [("error", 2)]
    with pytest.raises(ValueError):
        live.run_to_table(windows, "update")


def test_a_file_cut_in_place_that_regrows_with_the_same_first_line(spark, tmp_path):
    path, state = tmp_path / "a.log", str(tmp_path / "state")
    path.write_text("banner\none\n")
    source = reader([path])
    rows, offset = drain(source, {})
    with open(path, "r+") as fh:        # the same inode
        fh.truncate(0)
        fh.write("banner\ntwo\nthree, longer than before\n")
    new, later = drain(source, offset)
    assert [r["line"] for r in new] == ["banner", "two", "three, longer than before"]
    assert later[str(path)]["turn"] == 1 and new[0]["generation"] != rows[0]["generation"]
    # A restarted query plans the same range from the same offsets, and learns what it had read from its checkpoint.
    assert reader([path]).partitions(offset, later) == source.partitions(offset, later)
    run = lambda: live.run_to_table(live.live_totals(tail.tail_lines(spark, [str(path)], checkpoint=state)), "complete", state, str(tmp_path / "out")).first()
    assert run().total_lines == 3
    with open(path, "r+") as fh:
        fh.truncate(0)
        fh.write("banner\nfour\nfive\nsix, longer again than the one before it\n")
    assert run().total_lines == 7
    with open(path, "a") as fh:
        fh.write("seven\n")
    assert run().total_lines == 8


def test_budget(spark, tmp_path):
    paths = [str(tmp_path / "a.log"), str(tmp_path / "b.log")]
    body = [f"line {i} ERROR" for i in range(400)] + ["x" * 500]
    for path in paths:
        with open(path, "w") as fh:
            fh.write("".join(x + "\n" for x in body))
    size = sum(len(x) + 1 for x in body)
    source = tail.TailReader({"paths": json.dumps(paths), "maxBytes": str(size // 5)})
    rows, offset, batches = [], {}, 0
    while True:
        new, offset = drain(source, offset)
        if not new:
            break
        assert sum(len(r["line"]) + 1 for r in new) <= size // 5 + 1200
        rows, batches = rows + new, batches + 1
    assert batches >= 10 and len(rows) == 2 * len(body) == len({(r["file"], r["offset"]) for r in rows})
    state = str(tmp_path / "state")
    run = lambda: live.run_to_table(live.live_totals(tail.tail_lines(spark, paths, max_bytes=size // 3, checkpoint=state)),
                                    "complete", state, str(tmp_path / "out"), catch_up=True).first()
    assert (run().total_lines, run().error_lines) == (2 * len(body), 800)
    with open(paths[0], "a") as fh:
        fh.write("more\n")
    assert run().total_lines == 2 * len(body) + 1
    with pytest.raises(ValueError, match="checkpoint"):
        tail.tail_lines(spark, paths, max_bytes=10)


def test_reset_of_one_path(spark, tmp_path):
    paths, state = [str(tmp_path / "a.log"), str(tmp_path / "b.log")], str(tmp_path / "state")
    for path, n in zip(paths, (3, 5)):
        with open(path, "w") as fh:
            fh.write("x\n" * n)
    run = lambda resets: live.run_to_table(live.live_totals(tail.tail_lines(spark, paths, checkpoint=state, resets=resets)),
                                           "complete", state, str(tmp_path / "out")).first().total_lines
    assert run(None) == 8
    assert run({paths[0]: 1}) == 11
    assert run({paths[0]: 1}) == 11
    assert run({paths[0]: 2, paths[1]: 7}) == 19


def test_live_context_equals_batch(spark, make_lines, tmp_path, c=2):
    files = [[f"pool {i}" if i % 7 in (0, 1) else f"row {i}" for i in range(n)] for n in (40, 23)]
    paths = [str(tmp_path / "f0.log"), str(tmp_path / "f1.log")]
    prompt = resolve_prompt(spark, "pool")
    cuts = [(0, 0), (15, 3), (36, 4), (40, 23)]
    for (a0, a1), (b0, b1) in zip(cuts, cuts[1:]):
        for path, lines in zip(paths, (files[0][a0:b0], files[1][a1:b1])):
            with open(path, "a") as fh:
                fh.write("".join(x + "\n" for x in lines))
        got = live.run_live_context(tail.tail_lines(spark, paths, 100, checkpoint=str(tmp_path / "state")), prompt, c,
                                    str(tmp_path / "out"), str(tmp_path / "carry"), str(tmp_path / "state"), chunk_bits=3)
        want = [(o, i, "\n".join(f[max(0, i - c):i + c + 1])) for o, f in ((0, files[0][:b0]), (1, files[1][:b1])) for i, x in enumerate(f) if "pool" in x]
        assert sorted((r.file_ord, r.line_no, r.context) for r in got.collect()) == want
    with open(paths[1], "w") as fh:
        fh.write("pool anew\n")
    got = live.run_live_context(tail.tail_lines(spark, paths, 100, checkpoint=str(tmp_path / "state")), prompt, c,
                                str(tmp_path / "out"), str(tmp_path / "carry"), str(tmp_path / "state"), chunk_bits=3)
    assert sorted((r.file_ord, r.line_no, r.context) for r in got.collect()) == sorted([*want, (1, 0, "pool anew")])
