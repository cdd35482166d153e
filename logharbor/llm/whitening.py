"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay distributed. A step sends one direction v out and brings
X v, and X' times that, back as sums over the rows, so a step is one pass. The left
vectors u have one entry a row; they are never gathered or stored: u = X z for a
short z known to the driver, and each pass also brings the products with all
earlier u, from which both sides are orthogonalised anew. The singular values of the
small bidiagonal matrix give the deviations, its right vectors the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import small_batches, written

COMPONENTS = 32
# Fixed values of the whole numbers that entries become: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
# Entries beyond this give no whole number of 64 bits.
LARGEST = 2.0 ** 56
# Shares of the largest singular value, of the total variance, below which nothing is left.
TINY, REST = 1e-13, 1e-14


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x of the usable rows: array<bigint> of floor(64 c) + 1000000."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    # The test is repeated in the value, since a filter does not promise to run before it.
    return embeddings.where(ok).select("vec_id", F.when(ok, whole).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((len(column), 0), np.int64)


class Centred:
    """Rows of whole numbers, centred: the mean is a whole part and a fraction, so nothing is rounded before the end."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * (s // n) for s in sums]
        self.fraction = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exact; by Python's numbers where 64 bits might not hold it."""
        away = x - self.whole
        most = int(np.abs(away).max(initial=0)) + 1
        if x.shape[1] * (most * self.n) ** 2 < 1 << 62:
            moved = away * self.n - np.array(self.rest, np.int64)
            return (moved * moved).sum(1).tolist()
        return [sum((a * self.n - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in away.tolist()]


def _sums(batches, part_of):
    """One row (i, v) for each entry of what the parts of all batches of a task add up to."""
    total = None
    for batch in batches:
        part = part_of(batch)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])


def _total(rows: DataFrame, part_of, size: int) -> np.ndarray:
    """Sums over all rows of a vector of ``size`` that ``part_of`` takes from each batch."""
    parts = rows.mapInArrow(lambda batches: _sums(batches, part_of), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in parts.collect():
        out[r.i] = r.v
    return out


class Step:
    """What one pass brings for p = X a: X'p, |p|^2, and p's products with the columns of X Z."""

    def __init__(self, centred: Centred, a: np.ndarray, z: np.ndarray) -> None:
        self.centred, self.a, self.z = centred, a, z

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        y = self.centred.rows(_matrix(batch, len(self.a)))
        p = y @ self.a
        return np.concatenate((p @ y, [p @ p], p @ (y @ self.z)))


def bidiagonalise(rows: DataFrame, centred: Centred, total: float, steps: int | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (one a column) and the small matrix B with X V = U B, U'U = V'V = 1; ``total`` is X's sum of squares.

    At most ``steps`` passes, by default one a dimension, fewer where the products
    have taken up all variance. Where a left or right vector vanishes, the space so
    far is closed, and the next begins from a new direction outside of it, so equal
    and vanishing singular values are found too.
    """
    d = len(centred.sums)
    draw = np.random.default_rng(seed)
    v = np.zeros((d, 0))
    z, xu, gram = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0))
    b = np.zeros((0, 0))
    largest, taken, beta = 0.0, 0.0, 0.0
    following = None
    while total > 0 and v.shape[1] < min(d, steps or d) and taken < total * (1 - REST):
        if following is None:
            following, beta = draw.normal(size=d), 0.0
            for _ in range(2):
                following -= v @ (v.T @ following)
            following /= np.linalg.norm(following)
        k = z.shape[1]
        v = np.column_stack((v, following))
        # The next left vector before its length is known: X v less what the last one takes, as coefficients.
        a = following - (beta * z[:, -1] if beta else 0.0)
        brought = _total(rows, Step(centred, a, z), d + 1 + k)
        back, square, along = brought[:d], brought[d], brought[d + 1:]
        # Full reorthogonalisation: what p has along earlier left vectors is taken out, twice, by their measured products.
        out = along.copy()
        out += along - gram @ out
        left = square - 2 * out @ along + out @ gram @ out
        alpha = np.sqrt(max(left, 0.0))
        largest = max(largest, alpha, beta)
        grown = np.zeros((k + 1, v.shape[1]))
        grown[:k, :v.shape[1] - 1] = b
        if beta:
            grown[k - 1, -1] = beta
            taken += beta * beta
        following = None
        if alpha > TINY * largest * np.sqrt(max(1, d)):
            z = np.column_stack((z, (a - z @ out) / alpha))
            xu = np.column_stack((xu, (back - xu @ out) / alpha))
            row = (along - gram @ out) / alpha
            gram = np.block([[gram, row[:, None]], [row[None, :], np.ones((1, 1))]])
            grown[k, -1] = alpha
            taken += alpha * alpha
            ahead = xu[:, -1].copy()
            for _ in range(2):
                ahead -= v @ (v.T @ ahead)
            beta = np.linalg.norm(ahead)
            largest = max(largest, beta)
            if beta > TINY * largest * np.sqrt(max(1, d)):
                following = ahead / beta
            else:
                beta = 0.0
        else:
            grown, beta = grown[:k], 0.0
        b = grown
    return v, b


class Whitener:
    """Components (one a column), their variances, and the share of each in all variance."""

    def __init__(self, centred: Centred, v: np.ndarray, b: np.ndarray, total: float, most: int) -> None:
        self.centred = centred
        _, s, right = np.linalg.svd(b) if b.size else (None, np.zeros(0), np.zeros((0, 0)))
        keep = int((s > np.sqrt(REST) * s[0]).sum()) if len(s) else 0
        keep = min(keep, most)
        self.components = (v @ right.T)[:, :keep]
        # The Ritz vectors are brought back to length one and right angles.
        self.components, _ = np.linalg.qr(self.components) if keep else (self.components, None)
        self.variances = s[:keep] ** 2 / centred.n
        self.explained = self.variances / (total / centred.n) if keep else np.zeros(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred.rows(x) @ self.components / np.sqrt(self.variances)


def _products(whitener: Whitener, dims: int):
    def part(batch: pa.RecordBatch) -> np.ndarray:
        w = whitener(_matrix(batch, dims))
        return np.concatenate(((w.T @ w).ravel(), w.sum(0)))

    return part


def _whitened(whitener: Whitener, dims: int, error: float):
    k, n = len(whitener.variances), whitener.centred.n

    def rows(batches):
        for batch in batches:
            x = _matrix(batch, dims)
            many = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), k)))
            away = whitener.centred.deviations(x)
            long = pa.array([a if a < 1 << 63 else None for a in away], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)),
                 long.take(pa.array(np.repeat(np.arange(many), k))), pa.array(whitener(x).ravel()),
                 pa.array(np.tile(whitener.explained, many)), pa.array(np.full(many * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows


def whiten(embeddings: DataFrame, most: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of the usable rows and up to ``most`` components.

    Rows whose vector is null or holds null or non-finite entries go, as do entries
    of 2**56 or more, which no long holds times 64, and vectors of another length than
    the commonest (of equally common ones the longest). Entries become whole numbers,
    centred exactly. ``explained`` is a component's share of all variance.
    ``identity_error`` is measured from the whitened rows in a last pass, not assumed.
    Components without variance (constant or dependent dimensions, a single row)
    cannot be whitened and give no rows. A deviation beyond a long is null. Repeated
    rows count and return as often as they stand; null ids stay; other columns are
    not read; an empty table gives an empty result. Equal variances come in any order.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    kind = dict(embeddings.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = written(whole_vectors(embeddings), "whole")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, n = (sizes.d, sizes["count"]) if sizes else (0, 0)
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    found = (rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).collect())
    centred = Centred(n, [int(r.s) for r in sorted(found, key=lambda r: r.i)])
    total = float(_total(rows, lambda batch: np.array([(centred.rows(_matrix(batch, d)) ** 2).sum()]), 1)[0])
    v, b = bidiagonalise(rows, centred, total, steps)
    whitener = Whitener(centred, v, b, total, most)
    k = len(whitener.variances)
    if not k:
        return spark.createDataFrame([], schema)
    sums = _total(rows, _products(whitener, d), k * k + k)
    means = sums[k * k:] / n
    error = float(np.abs(sums[: k * k].reshape(k, k) / n - np.outer(means, means) - np.eye(k)).max())
    return rows.mapInArrow(_whitened(whitener, d, error), schema)
