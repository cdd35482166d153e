import pytest
from pyspark.sql import functions as F

from logharbor.operators import health
from logharbor.operators.positions import with_position
from logharbor.sources import logfiles


@pytest.fixture
def small_splits(spark):
    """Read files in splits of a few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(frame):
    return [(r.file, r.file_ord, r.line_no, r.line) for r in frame.orderBy("file_ord", "line_no").collect()]


def python_lines(path):
    with open(path, encoding="utf-8", errors="ignore") as fh:
        return [ln.rstrip("\r\n") for ln in fh.readlines()]


def test_numbering_over_many_splits(spark, tmp_path, small_splits):
    files = {
        "b.log": "".join(f"line {i} {'x' * (i % 90)}\n" for i in range(200)),
        "a.log": "one\ntwo\n\nfour without end",
        "empty.log": "",
        "with space+%41.log": "s\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    paths = [str(tmp_path / n) for n in files]
    got = read(logfiles.read_lines(spark, paths))
    assert got == [(p, o, i, x) for o, p in enumerate(paths) for i, x in enumerate(python_lines(p))]
    splits = logfiles._scan(spark, paths[:1]).select("block").distinct().count()
    assert splits > 20


def test_line_ends_and_bad_bytes(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes("a\r\nb\rc\n".encode() + b"d\xff\xfee\xc3\n" + "é�日本\n".encode())
    got = read(logfiles.read_lines(spark, [str(path)]))
    assert [g[3] for g in got] == python_lines(path) == ["a", "b", "c", "de", "é�日本"]


def test_the_same_file_twice(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    p = str(tmp_path / "a.log")
    assert read(logfiles.read_lines(spark, [p, p])) == [(p, o, i, x) for o in (0, 1) for i, x in enumerate("xy")]


def test_missing_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "in.log").write_text("y\n")
    asked = [str(tmp_path / n) for n in ("gone.log", "a.log", "dir", "empty.log", "lost/b.log")]
    got = [(r.file, r.file_ord) for r in logfiles.missing_files(spark, asked).collect()]
    assert got == [(asked[0], 0), (asked[2], 2), (asked[4], 4)]
    logs = logfiles.open_logs(spark, asked)
    assert read(logs.lines) == [(asked[1], 1, 0, "x")]
    assert [(r.file, r.file_ord) for r in logs.missing.collect()] == got
    counted = logs.line_counts.orderBy("file_ord").collect()
    assert [(r.file, r.lines) for r in counted] == list(zip(asked, [0, 1, 0, 0, 0]))


def test_all_files_missing(spark, tmp_path):
    asked = [str(tmp_path / "gone.log")]
    assert logfiles.read_lines(spark, asked).count() == 0
    assert logfiles.missing_files(spark, asked).count() == 1
    assert [r.lines for r in logfiles.open_logs(spark, asked).line_counts.collect()] == [0]
    with pytest.raises(ValueError):
        logfiles.read_lines(spark, ["", "  "])
    assert logfiles.split_paths(" a.log, ,b.log,") == ["a.log", "b.log"]


def test_expand(spark, tmp_path):
    for n in ("b/2.log", "b/1.log", "a.log"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x\n")
    got = logfiles.expand(spark, [str(tmp_path / "b"), str(tmp_path / "*.log")])
    assert got == [str(tmp_path / n) for n in ("b/1.log", "b/2.log", "a.log")]


def test_changed_splits_fail_loudly(spark, tmp_path, small_splits):
    path = tmp_path / "a.log"
    path.write_text("".join(f"line {i}\n" for i in range(400)))
    lines = logfiles.read_lines(spark, [str(path)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    with pytest.raises(Exception, match="file splits changed"):
        read(lines)


@pytest.mark.parametrize("end", ["\n", ""])
def test_a_file_that_grows_keeps_its_first_lines(spark, tmp_path, small_splits, end):
    path = tmp_path / "a.log"
    body = "\n".join(f"line {i}" for i in range(40))
    path.write_text(body + end)
    lines = logfiles.read_lines(spark, [str(path)])
    with open(path, "a") as fh:
        fh.write("\nmore\n" if not end else "more\nand more\n")
    assert [r[3] for r in read(lines)] == body.split("\n")


def test_names_with_glob_characters_and_hidden_names(spark, tmp_path):
    for name in ("app[1].log", "app1.log", "a*b{c}.log", "_app.log", ".app.log"):
        (tmp_path / name).write_text(f"in {name}\n")
    asked = [str(tmp_path / n) for n in ("app[1].log", "a*b{c}.log", "app?.log")]
    assert [x[3] for x in read(logfiles.read_lines(spark, asked))] == ["in app[1].log", "in a*b{c}.log"]
    assert [r.file for r in logfiles.missing_files(spark, asked).collect()] == asked[2:]
    for name in ("_app.log", ".app.log"):
        with pytest.raises(ValueError, match="begin with"):
            logfiles.present_files(spark, [str(tmp_path / name)])


def test_land_keeps_results_and_prunes_columns(spark, make_lines, tmp_path):
    lines = make_lines(["2024-01-01 10:00:00 ERROR x", "   at y"], ["fine"])
    landed = logfiles.land(lines, str(tmp_path / "t"))
    assert {"ts", "tag_mask", "pos"} <= set(landed.columns)
    assert health.totals(health.bucket_summary(landed)).first() == health.totals(health.bucket_summary(lines)).first()
    plan = health.bucket_summary(landed)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "line:" not in schema and "file:" not in schema
    errors = health.error_lines(landed)._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(tag_mask,0))" in errors


def test_any_table_as_lines(spark):
    frame = spark.createDataFrame([("svc-b", 1, "y"), ("svc-b", 0, "ERROR x"), ("svc-a", 0, "z")], "app string, n int, msg string")
    lines = logfiles.text_table(frame, "msg", "app", "n")
    assert read(lines) == [("svc-a", 0, 0, "z"), ("svc-b", 1, 0, "ERROR x"), ("svc-b", 1, 1, "y")]
    assert with_position(lines).select(F.max("pos")).first()[0] == (1 << 40) + 1


@pytest.mark.parametrize("more", ["y" * 900 + "\nnext\n", "\nnext\nand next\n"])
def test_a_last_line_longer_than_a_split_may_grow(spark, tmp_path, small_splits, more):
    """Its first lines keep their numbers; lines begun later are left out."""
    path = tmp_path / "a.log"
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    body = [f"line {i}" for i in range(30)] + ["x" * (3 * split)]
    path.write_text("\n".join(body))
    lines = logfiles.read_lines(spark, [str(path)])
    with open(path, "a") as fh:
        fh.write(more)
    got = read(lines)
    assert [r[3] for r in got[:-1]] == body[:-1] and got[-1][3].startswith(body[-1]) and len(got) == len(body)


def test_missing_names(spark, tmp_path):
    for name in ("a.log", "sub/b.log", "c d%.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = [f"{tmp_path}/{n}" for n in ("a.log", "sub/b.log", "c d%.log", "sub", "none.log")] + [None]
    asked = spark.createDataFrame(list(enumerate(names)), "n int, file string")
    assert sorted(r.n for r in logfiles.missing_names(asked, str(tmp_path)).collect()) == [3, 4, 5]
