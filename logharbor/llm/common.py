"""Words, hashes and joins shared by the text operators.

A word is a maximal run of bytes other than space and \\x09-\\x0D. ``bytes.split()``
and ``bytes.lower()`` have exactly that meaning, and know ASCII only, so texts
travel as UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.runtime import new_folder, ship_package

ship_package()

# A side of a join may be broadcast up to this many rows of a few longs each.
BROADCAST_ROWS = 2_000_000
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
BLOCK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ANY_SPACE = re.compile(rb"[ \t-\r]")
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the column as text, modulo ``m``; null where the column is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def text_bytes(col: str = "text") -> Column:
    """The text as bytes, null as empty."""
    return F.coalesce(F.col(col).cast("string").cast("binary"), F.lit(b""))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES: rows here are whole texts.

    Spark reads these settings when a job is planned, so they stay lowered.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class SpanHash:
    """64-bit hashes of byte spans, all spans of a buffer at once.

    A span's hash is a polynomial in the bytes' random codes; sums up to both
    ends, shifted to the span's start, give it without a loop over bytes.
    """

    def __init__(self) -> None:
        codes = np.arange(1, 257, dtype=_U)
        self.codes = mix(codes * _U(0xD1342543DE82EF95))
        self.up = self.down = np.ones(0, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    steps = np.full(n, base, _U)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=_U))

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            self._powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
            return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(_U))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, and the text number of each word."""
        joined = b" ".join(texts) + b" "
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        hashes, owners, at = [], [], 0
        while at < len(joined):
            stop = min(at + BLOCK_BYTES, len(joined))
            if stop < len(joined):
                found = _ANY_SPACE.search(joined, stop)
                stop = found.end() if found else len(joined)
            data = np.frombuffer(joined, np.uint8, stop - at, at)
            start, end = word_spans(data)
            hashes.append(self.spans(data, start, end))
            owners.append(np.searchsorted(begins, start + at, "right") - 1)
            at = stop
        if not hashes:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(owners)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of a byte array."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for i in range(size):
            out = out * _U(_BASE) + hashes[i:i + n]
        return mix(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash for the whole sequence, different for every length."""
    return windows(np.append(hashes, _U(len(hashes))), len(hashes) + 1)


def doc_slices(owners: np.ndarray, n: int) -> np.ndarray:
    """``n + 1`` bounds: words of text ``i`` are those from bound i to bound i + 1."""
    return np.searchsorted(owners, np.arange(n + 1))


def by_size(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` bytes, or one longer text."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > limit:
            yield first, i
            first, total = i, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_ids(big: DataFrame, ids: DataFrame, key: str, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join wide rows to narrow rows; these are broadcast only if counted and few.

    ``ids`` should be written already, since it is counted first.
    """
    few = ids.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(ids) if few else ids, key, how)
