"""Fixed leaders of any number of vectors, by an index of sign projections.

A vector's signs on random directions, a few at a time, name its *buckets*, one per
band. Vectors at or above the threshold share a bucket with a probability that
the number of bands sets (``banding``); only those are compared. A row is a leader
if no earlier row of its buckets that is a leader is similar enough.

Leaders are settled in rounds over the rows still open. In each bucket the first
open rows are compared among themselves; a row that no earlier open one of any of
its buckets is similar to is a leader. Open rows near a new leader are covered
and leave. Rows pass bucket by bucket, sorted, through tasks that hold one
block of leaders at a time, and buckets with many rows are dealt to several tasks, so
neither a task nor the driver ever holds a bucket, and no pairs are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.runtime import cut_lineage, ship_package, small_side

ship_package()

# Share of pairs at the threshold that meet in a bucket, and the most bands spent on it.
RECALL, MOST_BANDS = 0.999, 48
# First open rows of a bucket that a round compares among themselves; leaders compared with rows at once.
BLOCK_ROWS, BLOCK_LEADERS = 512, 4096
# A bucket with more rows than this is dealt to several tasks.
SPLIT_ROWS = 50_000
SEED = 20_240_501


def banding(threshold: float, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bits of a band, bands): the longest bands whose number stays in bounds.

    Two vectors at angle a agree in one sign with probability 1 - a/pi, so they share
    at least one of b bands of k signs with probability 1 - (1 - (1 - a/pi)^k)^b.
    """
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must lie in (0, 1], recall between 0 and 1")
    agree = 1 - math.acos(threshold) / math.pi
    for bits in range(24, 0, -1):
        share = min(agree ** bits, 1 - 1e-12)
        bands = math.ceil(math.log(1 - recall) / math.log(1 - share))
        if bands <= most_bands:
            return bits, max(1, bands)
    raise ValueError(f"recall {recall} at threshold {threshold} needs more than {most_bands} bands")


def _directions(length: int, count: int) -> np.ndarray:
    return np.random.default_rng((SEED, length)).normal(size=(length, count))


def _codes(bits: int, bands: int):
    """Adds ``codes``: per band the signs of the vector as one number."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64"), _ends(vectors)
            sizes = np.diff(ends)
            codes = np.zeros((len(sizes), bands), np.int64)
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                m = flat[ends[at][:, None] + np.arange(length)]
                signs = (m @ _directions(length, bits * bands) >= 0).reshape(len(at), bands, bits)
                codes[at] = signs @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "codes"])

    return rows


def _ends(lists: pa.Array) -> np.ndarray:
    """Bounds of each list in the flattened values."""
    bounds = np.asarray(lists.offsets)
    return bounds - bounds[0]


def _in_buckets(rows: DataFrame, kind: int) -> DataFrame:
    """One row per band: bucket, kind, pos, embedding. A bucket never mixes groups or lengths."""
    code = F.posexplode("codes").alias("band", "code")
    return rows.select("grp", "pos", "embedding", code).select(
        F.xxhash64("grp", F.size("embedding"), "band", "code").alias("bucket"), F.lit(kind).alias("kind"), "pos", "embedding")


def _units(flat: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
    m = flat[ends[a]:ends[b]].reshape(b - a, -1).astype("float64")
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _groups(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Bounds of the runs of equal keys in a sorted batch."""
    n = batch.num_rows
    edge = np.zeros(n, bool)
    edge[0] = True
    for k in keys:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        edge[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(edge), n)


def _blocked(threshold: float):
    """Rows sorted by bucket and pos -> pos, blocked: is an earlier row of the bucket similar?"""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("embedding")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), _ends(vectors)
            buckets, bounds = batch.column("bucket").to_pylist(), _groups(batch, ["bucket"])
            blocked = np.zeros(batch.num_rows, bool)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                before = held if buckets[a] == now else None
                now = buckets[a]
                last = b == batch.num_rows
                if b - a == 1 and before is None and not last:
                    continue
                own = _units(flat, ends, a, b)
                whole = own if before is None else np.concatenate((before, own))
                near = np.tril(own @ whole.T >= threshold, len(whole) - len(own) - 1)
                blocked[a:b] = near.any(1)
                held = whole if last else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(blocked)], names=["pos", "blocked"])

    return rows


class Best:
    """Most similar earlier leader of each row of one block of leaders."""

    def __init__(self) -> None:
        self.key, self.pos, self.parts, self.heads = None, np.zeros(0, np.int64), [], None

    def begin(self, key: tuple) -> None:
        if key != self.key:
            self.key, self.pos, self.parts, self.heads = key, np.zeros(0, np.int64), [], None

    def add(self, pos: np.ndarray, units: np.ndarray) -> None:
        self.pos = np.concatenate((self.pos, pos))
        self.parts.append(units)
        self.heads = None

    def of(self, pos: np.ndarray, units: np.ndarray, earlier: bool) -> tuple[np.ndarray, np.ndarray]:
        """Leader and similarity of each row, -inf where there is none; the first of equals."""
        if self.heads is None:
            order = np.argsort(self.pos)
            self.pos, self.parts = self.pos[order], [np.concatenate(self.parts)[order]]
            self.heads = self.parts[0].T
        sims = units @ self.heads
        if earlier:
            sims = np.where(self.pos[None, :] <= pos[:, None], sims, -np.inf)
        at = sims.argmax(1)
        return self.pos[at], sims[np.arange(len(pos)), at]


def _nearest(keys: list[str], least: float, earlier: bool):
    """Rows sorted by the keys and kind (leaders, 0, first) -> pos, leader_id, leader_similarity of rows that reach ``least``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best()
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("embedding")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), _ends(vectors)
            pos = batch.column("pos").to_numpy()
            kinds = batch.column("kind").to_pylist()
            bounds = _groups(batch, [*keys, "kind"])
            names = list(zip(*(batch.column(k).take(pa.array(bounds[:-1])).to_pylist() for k in keys), strict=True))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for key, a, b in zip(names, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                best.begin(key)
                if kinds[a] == 0:
                    best.add(pos[a:b], _units(flat, ends, a, b))
                elif len(best.pos):
                    leaders, sims = best.of(pos[a:b], _units(flat, ends, a, b), earlier)
                    ok = sims >= least
                    found.append((pos[a:b][ok], leaders[ok], sims[ok]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)],
                                                 names=["pos", "leader_id", "leader_similarity"])

    return rows


_FOUND = "pos bigint, leader_id bigint, leader_similarity double"


def _large_buckets(rows: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """bucket, deals, blocks of the buckets whose rows go to several tasks or whose leaders come in several blocks.

    They number at most all rows of all buckets by SPLIT_ROWS or BLOCK_LEADERS, and are broadcast if that is few.
    """
    both = _in_buckets(rows, 1).select("bucket", "kind")
    if leaders is not None:
        both = both.unionAll(_in_buckets(leaders, 0).select("bucket", "kind"))
    sizes = both.groupBy("bucket").agg(F.count_if(F.col("kind") == 1).alias("_rows"), F.count_if(F.col("kind") == 0).alias("_leaders"))
    large = sizes.select("bucket", *(F.greatest(F.ceil(F.col(c) / n), F.lit(1)).cast("int").alias(name) for c, n, name in (
        ("_rows", SPLIT_ROWS, "deals"), ("_leaders", BLOCK_LEADERS, "blocks")))).where("deals > 1 OR blocks > 1")
    return small_side(large)[0]


def _compared(rows: DataFrame, leaders: DataFrame, least: float, earlier: bool, large: DataFrame) -> DataFrame:
    """Most similar leader of each row among those of its buckets: pos, leader_id, leader_similarity.

    In ``large`` buckets leaders come in blocks, and rows go to every block; rows
    are dealt to several tasks, and leaders go to every deal.
    """
    def dealt(side: DataFrame, kind: int) -> DataFrame:
        known = side.join(large, "bucket", "left").na.fill(1, ["deals", "blocks"])
        own, other = ("deals", "blocks") if kind == 1 else ("blocks", "deals")
        mine = F.pmod(F.xxhash64("pos"), own).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        names = ("_deal", "_block") if kind == 1 else ("_block", "_deal")
        return known.select("bucket", "kind", "pos", "embedding", mine.alias(names[0]), every.alias(names[1])).select(
            "bucket", "_deal", "_block", "kind", "pos", "embedding")

    keys = ["bucket", "_deal", "_block"]
    sorted_rows = (dealt(_in_buckets(leaders, 0), 0).unionAll(dealt(_in_buckets(rows, 1), 1))
                   .repartition(*keys).sortWithinPartitions(*keys, "kind"))
    return first_best(sorted_rows.mapInArrow(_nearest(keys, least, earlier), _FOUND))


def first_best(found: DataFrame) -> DataFrame:
    """One row per pos: highest similarity, then the earliest leader."""
    return found.groupBy("pos").agg(F.max(F.struct("leader_similarity", (-F.col("leader_id")).alias("_id"))).alias("_b")).select(
        "pos", (-F.col("_b._id")).alias("leader_id"), F.col("_b.leader_similarity").alias("leader_similarity"))


def has_direction(vector: str = "embedding") -> Column:
    """Whether a vector is there, finite throughout and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def settle_leaders(rows: DataFrame, threshold: float, block: int = BLOCK_ROWS) -> DataFrame:
    """The leaders among ``rows(grp, pos, embedding, codes)``, in rounds."""
    still_open, found = rows, None
    # A round's new leaders of a bucket are of one block, so only the rows may be many.
    large = _large_buckets(rows)
    bands = F.size("codes")
    while True:
        parts = _in_buckets(still_open, 1)
        first = parts.withColumn("_at", F.expr("row_number() OVER (PARTITION BY bucket ORDER BY pos)")).where(F.col("_at") <= block)
        seen = first.select("bucket", "pos", "embedding").mapInArrow(_blocked(threshold), "pos bigint, blocked boolean")
        free = seen.groupBy("pos").agg(F.count("*").alias("_seen"), F.max("blocked").alias("_blocked")).where("NOT _blocked")
        new = cut_lineage(still_open.join(free, "pos").where(F.col("_seen") == bands).select(*rows.columns))
        found = new if found is None else found.unionAll(new)
        # A new leader is its own nearest one, so it leaves with those it covers.
        near = _compared(still_open, new, threshold, True, large).select("pos").unionAll(new.select("pos")).distinct()
        still_open = cut_lineage(still_open.join(near, "pos", "left_anti"))
        if still_open.isEmpty():
            return found


def fixed_leaders(vectors: DataFrame, threshold: float = K.CLUSTER_SIMILARITY, group: str | None = None,
                  recall: float = RECALL, most_bands: int = MOST_BANDS, block: int = BLOCK_ROWS) -> DataFrame:
    """Cluster any number of rows ``(pos, embedding, ...)``, per ``group`` if named: adds ``leader_id, leader_similarity``.

    A row is a leader if no earlier leader is similar enough; other rows join their
    most similar earlier leader, the first of equals. ``leader_id`` is the
    leader's ``pos``, which must be unique. Rows whose vector is null, zero or holds null or
    non-finite entries are near nothing and lead themselves; vectors of different
    lengths never meet. The result does not depend on partitions. Pairs that
    share no bucket are not compared: at the threshold that is a share of at most
    1 - ``recall``, above it less.
    """
    bits, bands = banding(threshold, recall, most_bands)
    columns = vectors.columns
    key = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = vectors.select(key.alias("grp"), F.col("pos").cast("bigint").alias("pos"), F.when(has_direction(), F.col("embedding")).alias("embedding"))
    kind = dict(rows.dtypes)["embedding"]
    rows = rows.where("embedding IS NOT NULL")
    indexed = cut_lineage(rows.mapInArrow(_codes(bits, bands), f"grp string, pos bigint, embedding {kind}, codes array<bigint>"))
    # Equal vectors: only the first of them can lead.
    firsts = indexed.groupBy("grp", "embedding").agg(F.min("pos").alias("pos"), F.first("codes").alias("codes")).select(*indexed.columns)
    leaders = settle_leaders(cut_lineage(firsts), threshold, block)
    joined = _compared(indexed, leaders, threshold, True, _large_buckets(indexed, leaders))
    own = leaders.select("pos", F.lit(True).alias("_own"))
    return (
        vectors.join(joined, "pos", "left").join(own, "pos", "left")
        .withColumn("leader_id", F.when(F.col("_own"), F.col("pos")).otherwise(F.coalesce("leader_id", F.col("pos"))).cast("bigint"))
        .withColumn("leader_similarity", F.when(F.col("leader_id") == F.col("pos"), F.lit(1.0)).otherwise(F.col("leader_similarity")))
        .select(*columns, "leader_id", "leader_similarity")
    )


def nearest_leader(rows: DataFrame, leaders: DataFrame, vector: str = "embedding", block: int = BLOCK_LEADERS) -> DataFrame:
    """Most similar of all leaders ``(leader_id, embedding)`` for each row: adds ``leader_id, leader_similarity``; the first wins ties.

    Leaders travel in blocks, rows to each block; the sides meet by block and a deal
    of the rows. ``pos`` must be unique. A vector without direction has similarity 0
    to all; without any leader ``leader_id`` is -1.
    """
    spark = rows.sparkSession
    heads = cut_lineage(leaders.select(F.col("leader_id").cast("bigint").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding")))
    blocks = max(1, -(-heads.count() // block))
    deals = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = rows.select(F.col("pos").cast("bigint").alias("pos"), F.col(vector).cast("array<double>").alias("embedding"))

    def side(part: DataFrame, kind: int) -> DataFrame:
        own, other = (deals, blocks) if kind == 1 else (blocks, deals)
        mine, every = F.pmod(F.xxhash64("pos"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        names = ("_deal", "_block") if kind == 1 else ("_block", "_deal")
        return part.where(has_direction()).select(mine.alias(names[0]), every.alias(names[1]), "pos", "embedding", F.lit(kind).alias("kind")).select(
            "_deal", "_block", "kind", "pos", "embedding")

    keys = ["_deal", "_block"]
    met = side(heads, 0).unionAll(side(given, 1)).repartition(*keys).sortWithinPartitions(*keys, "kind")
    found = first_best(met.mapInArrow(_nearest(keys, -2.0, False), _FOUND))
    # A leader without direction has similarity 0 to every row, and a row without direction to every leader.
    first, flat = heads.agg(F.min("pos")).scalar(), heads.where(~has_direction()).agg(F.min("pos")).scalar()
    scored = rows.join(found, "pos", "left").withColumns({"_first": first, "_flat": flat})
    takes = (F.col("leader_similarity") < 0) | ((F.col("leader_similarity") == 0) & (F.col("_flat") < F.col("leader_id")))
    leader = F.when(F.col("leader_id").isNull(), F.col("_first")).when(F.col("_flat").isNotNull() & takes, F.col("_flat")).otherwise(F.col("leader_id"))
    score = F.when(F.col("leader_id").isNull() | (F.col("_flat").isNotNull() & takes), F.lit(0.0)).otherwise(F.col("leader_similarity"))
    return scored.select(*rows.columns, F.coalesce(leader, F.lit(-1).cast("bigint")).alias("leader_id"), score.alias("leader_similarity"))
