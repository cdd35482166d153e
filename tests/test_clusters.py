import numpy as np
import pytest
from pyspark.sql import functions as F

from logharbor.operators import clustering, leaderindex, similarity, vectorlists
from logharbor.operators.embedding import HashedTokens
from logharbor.plans import reports
from logharbor.runtime import new_folder


def vectors(spark, matrix, groups=None):
    rows = [(i, [float(x) for x in v], 0 if groups is None else groups[i]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "pos bigint, embedding array<float>, grp int")


def cos(a, b):
    na, nb = np.sqrt(a @ a), np.sqrt(b @ b)
    return float(a @ b / (na * nb)) if na and nb else 0.0


def running_means(matrix, t):
    members, means, out = [], [], []
    for v in matrix:
        sims = [cos(v, m) for m in means]
        best = int(np.argmax(sims)) if sims else -1
        if sims and sims[best] >= t:
            members[best].append(v)
            means[best] = np.mean(members[best], axis=0)
        else:
            best = len(means)
            members.append([v])
            means.append(v)
        out.append(best)
    return out


def fixed(matrix, t):
    leaders, out = [], []
    for i, v in enumerate(matrix):
        sims = [cos(v, matrix[j]) for j in leaders]
        if sims and max(sims) >= t:
            out.append(leaders[int(np.argmax(sims))])
        else:
            leaders.append(i)
            out.append(i)
    return out


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(120, 5)).astype("float32").astype("float64")
    m[7] = 0.0
    m[50] = m[3]
    m[90] = 0.0
    return m


@pytest.mark.parametrize("t", [0.3, 0.82, 0.99])
def test_running_means(spark, matrix, t):
    got = clustering.leader_clusters(vectors(spark, matrix).repartition(5), t).orderBy("pos").collect()
    assert [r.cluster_id for r in got] == running_means(matrix, t)


def test_running_means_per_group(spark, matrix):
    groups = [i % 3 for i in range(len(matrix))]
    got = clustering.leader_clusters(vectors(spark, matrix, groups), 0.6, group="grp").orderBy("pos").collect()
    for g in range(3):
        assert [r.cluster_id for r in got if r.grp == g] == running_means(matrix[g::3], 0.6)


def test_large_groups_are_refused(spark, matrix):
    with pytest.raises(Exception, match="exceeds 100"):
        clustering.leader_clusters(vectors(spark, matrix), 0.5, limit=100).collect()


EXACT = 1 - 1e-9


@pytest.mark.parametrize(("block", "split", "leaders", "t"), [(1, 3, 2, 0.5), (7, 20, 5, 0.82), (512, 50_000, 4096, 0.5)])
def test_fixed_leaders(spark, monkeypatch, matrix, t, block, split, leaders):
    monkeypatch.setattr(leaderindex, "SPLIT_ROWS", split)
    monkeypatch.setattr(leaderindex, "BLOCK_LEADERS", leaders)
    if block == 1:
        matrix = matrix[:14]
    got = leaderindex.fixed_leaders(vectors(spark, matrix).repartition(3), t, recall=EXACT, most_bands=100, block=block).orderBy("pos").collect()
    assert [r.leader_id for r in got] == fixed(matrix, t)
    for r in got:
        want = 1.0 if r.leader_id == r.pos else cos(matrix[r.pos], matrix[r.leader_id])
        assert r.leader_similarity == pytest.approx(want, abs=1e-9)


def test_fixed_leaders_per_group_and_odd_vectors(spark, matrix):
    groups = [i % 3 for i in range(len(matrix))]
    got = {r.pos: r.leader_id for r in leaderindex.fixed_leaders(vectors(spark, matrix, groups), 0.6, "grp", EXACT, 100).collect()}
    for g in range(3):
        assert [got[3 * i + g] for i in range(40)] == [3 * x + g for x in fixed(matrix[g::3], 0.6)]
    odd = [(1, None, "a"), (2, [0.0, 0.0], "a"), (3, [1.0, 2.0], "a"), (4, [1.0, None], "a"), (5, [float("nan"), 1.0], "a"), (6, [], "a"),
           (7, [2.0, 4.0], "a"), (8, [1.0, 2.0, 0.0], "a"), (9, [float("inf"), 1.0], "a")]
    rows = spark.createDataFrame(odd, "pos bigint, embedding array<double>, bucket string")
    found = leaderindex.fixed_leaders(rows, 0.9)
    assert found.columns == ["pos", "embedding", "bucket", "leader_id", "leader_similarity"]
    assert {r.pos: r.leader_id for r in found.collect()} == {**{i: i for i in range(1, 10)}, 7: 3}
    assert leaderindex.fixed_leaders(rows.limit(0), 0.9).count() == 0


def test_a_large_group_is_clustered_whole(spark):
    """3,000 rows of one group, a third of them equal, another third nearly so: none is refused, few rounds."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2, 16))
    m = np.concatenate((np.repeat(base[:1], 1000, 0), base[1] + 0.05 * rng.normal(size=(1000, 16)), rng.normal(size=(1000, 16))))
    m = m[rng.permutation(len(m))]
    got = leaderindex.fixed_leaders(vectors(spark, m), 0.82, recall=EXACT, most_bands=100).orderBy("pos").collect()
    assert [r.leader_id for r in got] == fixed_fast(m, 0.82)


def fixed_fast(matrix, t):
    unit = matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))
    leaders, out = [], []
    for i, v in enumerate(unit):
        sims = unit[leaders] @ v if leaders else np.zeros(0)
        if len(sims) and sims.max() >= t:
            out.append(leaders[int(sims.argmax())])
        else:
            leaders.append(i)
            out.append(i)
    return out


@pytest.mark.parametrize("t", [0.82, 0.9])
def test_recall_of_the_index(t):
    """Share of pairs at just the threshold that meet in a bucket, by default bands; above it more do."""
    bits, bands = leaderindex.banding(t)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = t * x + np.sqrt(1 - t * t) * side / np.linalg.norm(side, axis=1, keepdims=True)
    away = leaderindex._directions(64, bits * bands)
    same = ((x @ away >= 0) == (y @ away >= 0)).reshape(len(x), bands, bits).all(2).any(1)
    assert same.mean() > 0.997


def test_banding_refuses():
    for bad in ((0.0, 0.9), (1.5, 0.9), (0.5, 1.0), (0.01, 1 - 1e-12)):
        with pytest.raises(ValueError):
            leaderindex.banding(*bad, most_bands=20)


@pytest.mark.parametrize("block", [2, 100])
def test_nearest_leader(spark, matrix, block):
    v = vectors(spark, matrix)
    heads = v.where("pos < 8").select(F.col("pos").alias("leader_id"), "embedding")
    got = leaderindex.nearest_leader(v, heads, block=block).orderBy("pos").collect()
    assert len(got) == len(matrix)
    for r in got:
        sims = [cos(matrix[r.pos], matrix[j]) for j in range(8)]
        assert r.leader_id == int(np.argmax(sims))
        assert r.leader_similarity == pytest.approx(max(sims), abs=1e-6)
    assert {r.leader_id for r in leaderindex.nearest_leader(v, heads.limit(0)).collect()} == {-1}


def test_report_lines_carry_no_vector(make_lines):
    r = reports.cluster(make_lines(LINES), "cluster errors by root cause", HashedTokens())
    assert "embedding" not in r.members._jdf.queryExecution().toString()


def test_weighted_centroids_equal_those_of_repeated_rows(spark, matrix):
    times = [1 + i % 4 for i in range(len(matrix))]
    rows = [(i % 3, [float(x) for x in v], n) for i, (v, n) in enumerate(zip(matrix, times, strict=True))]
    weighted = spark.createDataFrame(rows, "grp int, embedding array<double>, n int")
    each = weighted.withColumn("n", F.explode(F.expr("sequence(1, n)")))
    got, want = ({r.grp: r for r in clustering.centroids(f, "grp", w).collect()} for f, w in ((weighted, "n"), (each, None)))
    for g in range(3):
        assert got[g]["size"] == want[g]["size"] and got[g].centroid == pytest.approx(want[g].centroid)
        assert got[g].cohesion == pytest.approx(want[g].cohesion)


def test_centroids_and_cohesion(spark, matrix):
    got = clustering.centroids(vectors(spark, matrix, [i % 4 for i in range(len(matrix))]), "grp").collect()
    for r in got:
        part = matrix[r.grp::4]
        mean = part.mean(axis=0)
        assert r["size"] == len(part)
        assert r.centroid == pytest.approx(list(mean))
        assert r.cohesion == pytest.approx(np.mean([cos(v, mean) for v in part]))


@pytest.mark.parametrize("n", [1, 10, 500])
@pytest.mark.parametrize("bounded", [True, False])
def test_ranked_rows(spark, matrix, n, bounded):
    doubled = np.concatenate([matrix, matrix[:40]])
    q = matrix[3]
    want = [(i, round(cos(q, v), 4)) for i, v in enumerate(doubled) if cos(q, v) >= 0.1]
    want = sorted(want, key=lambda x: -x[1])[:n]
    got = similarity.rank_rows(vectors(spark, doubled), list(q), n, 0.1, bounded=bounded).collect()
    assert [r.pos for r in got] == [w[0] for w in want]
    assert [r.similarity for r in got] == pytest.approx([w[1] for w in want], abs=1e-4)


LINES = (
    ["2024-01-01 10:00:00 ERROR database connection refused"] * 3
    + ["2024-01-01 10:05:00 INFO fine"]
    + ["2024-01-01 11:00:00 ERROR disk quota exceeded now"] * 2
    + ["2024-01-01 12:00:00 CRITICAL payment gateway unreachable"]
)


def test_nothing_is_cut_by_default(make_lines):
    lines = [f"ERROR disk quota {'x' * 1500}{'ab'[i % 2]} full" for i in range(2_300)]
    r = reports.cluster(make_lines(lines), "cluster errors by root cause", HashedTokens())
    assert r.members.count() == 2_300 and r.total_error_lines == 2_300
    assert {s.cnt for s in reports.explain(make_lines(lines)).collect()} == {1_150}
    found = reports.analyze(make_lines(lines), prompt="disk quota", embedder=HashedTokens(), prompt_threshold=0.01)
    assert found.error_lines.count() == 2_300
    assert reports.search(make_lines(lines), "disk quota", 2_200, 0, embedder=HashedTokens(), prompt_threshold=0.01).count() == 2_200


@pytest.mark.parametrize("limit", [2000, None])
def test_cluster_report(make_lines, limit):
    r = reports.cluster(make_lines(LINES), "cluster errors by root cause", HashedTokens(), embed_limit=limit)
    got = [(c.label, list(c.keywords), c["size"], c.percentage, c.centroid_similarity) for c in r.clusters.collect()]
    assert got == [
        ("DATABASE CONNECTION REFUSED", ["database", "connection", "refused"], 3, 50.0, 1.0),
        ("DISK QUOTA EXCEEDED", ["disk", "quota", "exceeded", "now"], 2, 33.3, 1.0),
        ("PAYMENT GATEWAY UNREACHABLE", ["payment", "gateway", "unreachable"], 1, 16.7, 1.0),
    ]
    assert (r.total_error_lines, r.total_lines, r.prompt_threshold) == (6, 7, None)
    assert r.members.count() == 6


def test_cluster_report_with_prompt_and_window(make_lines):
    r = reports.cluster(make_lines(LINES), "disk quota exceeded in the last 1 hour", HashedTokens(), prompt_threshold=0.5)
    assert [(c["size"], c.percentage) for c in r.clusters.collect()] == [(2, 100.0)]
    assert (r.total_error_lines, r.time_window, r.prompt_threshold) == (2, "1:00:00", 0.5)


def test_cluster_report_when_nothing_is_near_the_prompt(make_lines):
    r = reports.cluster(make_lines(LINES), "zebra migration", HashedTokens())
    assert r.clusters.count() == 0 and r.total_error_lines == 6


def test_cluster_lines(make_lines):
    r = reports.cluster(make_lines(LINES), "cluster errors by root cause", HashedTokens(), max_clusters=1)
    assert [x.text for x in reports.cluster_lines(r.clusters).collect()] == [
        "DATABASE CONNECTION REFUSED (3 lines, 50.0%): database, connection, refused"
    ]


def test_display_weights(spark):
    sizes = spark.createDataFrame([("a", 4), ("b", 1)], "label string, size bigint")
    got = {r.label: (r.percentage, r.weight, r.font_size, r.opacity) for r in clustering.cluster_shares(sizes).collect()}
    assert got == {"a": (80.0, 1.0, 64, 1.0), "b": (20.0, 0.25, 27, 0.625)}


def test_top_of_lists(spark, monkeypatch):
    """Equal to ranking all rows; on clustered vectors few lists are read."""
    monkeypatch.setattr(vectorlists, "FILE_ROWS", 50)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    m = np.repeat(centres, 50, 0) + 0.05 * rng.normal(size=(600, 24))
    m[5] = 0.0
    v = vectors(spark, m).unionByName(spark.createDataFrame([(900, None, 0)], "pos bigint, embedding array<float>, grp int"))
    vectorlists.build_lists(v, folder := new_folder(spark, "lists-test"))
    for q, n, t in ((m[10], 7, 0.3), (m[10], 50, -1.0), (m[300], 1000, 0.1), (-m[10], 5, 0.9)):
        found = vectorlists.top_of_lists(spark, folder, [float(x) for x in q], n, t)
        want = similarity.rank_rows(v, [float(x) for x in q], n, t).collect()
        assert [(r.pos, r.similarity) for r in found.rows.collect()] == [(r.pos, r.similarity) for r in want]
    near = vectorlists.top_of_lists(spark, folder, [float(x) for x in m[10]], 7, 0.3)
    assert near.lists_read < near.lists / 2
    vectorlists.build_lists(v.where("embedding IS NULL"), empty := new_folder(spark, "lists-test"))
    assert vectorlists.top_of_lists(spark, empty, [1.0] * 24, 3, 0.1).rows.count() == 0
