"""Length buckets with the least padding, and token-budget batches inside them."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import written

BUCKETS = 16
# Longest row, and tokens of one batch with its padding.
MAX_TOKENS = 8_192
BUDGET = 65_536
# Rows of a bucket that are numbered together.
SLICE_ROWS = 50_000


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the at most ``buckets`` buckets that need the fewest padding tokens.

    Dynamic programming over the distinct lengths. With C and T the running
    counts and tokens, a bucket (i, j] pads ``L[j] * (C[j] - C[i]) - (T[j] - T[i])``,
    so the best i for j is the lowest of lines with falling slopes ``-C[i]`` at
    ``L[j]``: a queue of lines makes each bucket count linear in the lengths.
    More buckets never pad more; the fewest that reach the minimum are used.
    """
    lengths = sorted(n for n, c in histogram.items() if c > 0)
    d = len(lengths)
    if not d:
        return []
    C, T = [0], [0]
    for n in lengths:
        C.append(C[-1] + histogram[n])
        T.append(T[-1] + n * histogram[n])
    best: list[float] = [0.0] + [float("inf")] * d
    origin: list[list[int]] = []
    least = None
    for k in range(min(buckets, d)):
        now, came = [float("inf")] * (d + 1), [0] * (d + 1)
        lines: deque[tuple[int, float, int]] = deque()
        for j in range(1, d + 1):
            if best[j - 1] < float("inf"):
                line = (-C[j - 1], best[j - 1] + T[j - 1], j - 1)
                while len(lines) > 1 and _useless(lines[-2], lines[-1], line):
                    lines.pop()
                lines.append(line)
            x = lengths[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            if lines:
                slope, at_zero, i = lines[0]
                now[j], came[j] = slope * x + at_zero + x * C[j] - T[j], i
        origin.append(came)
        best = now
        if least is None or best[d] < least[0]:
            least = (best[d], k)
    out, j = [], d
    for k in range(least[1], -1, -1):
        out.append(lengths[j - 1])
        j = origin[k][j]
    return out[::-1]


def _useless(a, b, c) -> bool:
    """Whether line b is nowhere below both a and c, slopes falling from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def length_buckets(docs: DataFrame, buckets: int = BUCKETS, max_tokens: int = MAX_TOKENS, budget: int = BUDGET) -> DataFrame:
    """One row per document segment with its bucket, batch and padding.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``. A document longer than
    ``max_tokens`` is cut into segments of that length and a rest, none dropped;
    one without words is one segment of 0 tokens and never padded. The bucket
    bounds are the best for the histogram of all segment lengths, which has at
    most ``max_tokens + 1`` rows. A batch of a bucket holds as many segments as
    its bound allows within ``budget``, at least one; only a bucket's last batch
    may be smaller. Within a bucket, segments stand in order of a hash, then of
    ``doc_id`` and segment, so sources are mixed and repeated rows stand together.

    Columns: doc_id, segment, first_token, n_tokens, bucket (0 is the shortest),
    bucket_tokens, batch (number within the bucket), slot, padding. Rows with a
    null doc_id are packed like others; other columns are not read.
    """
    counted = docs.select("doc_id", F.expr(r"regexp_count(coalesce(CAST(text AS STRING), ''), '[^\\x20\\x09-\\x0D]+')").cast("long").alias("_all"))
    pieces = counted.select("doc_id", "_all", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(greatest(_all - 1, 0) DIV {max_tokens} AS INT)"))).alias("segment"))
    segments = written(pieces.select(
        "doc_id", "segment", F.expr(f"CAST(segment AS BIGINT) * {max_tokens}").alias("first_token"),
        F.expr(f"least({max_tokens}, _all - CAST(segment AS BIGINT) * {max_tokens})").alias("n_tokens")), "segments")
    histogram = {r.n_tokens: r.n for r in segments.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds = boundaries({n: c for n, c in histogram.items() if n}, buckets)
    if 0 in histogram:
        bounds = [0, *bounds]
    bound = F.lit(bounds[-1] if bounds else 0).cast("long")
    number = F.lit(max(0, len(bounds) - 1))
    for i in range(len(bounds) - 2, -1, -1):
        bound = F.when(F.col("n_tokens") <= bounds[i], F.lit(bounds[i]).cast("long")).otherwise(bound)
        number = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(number)
    slices = max(1, -(-sum(histogram.values()) // SLICE_ROWS))
    # Slices are ranges of the hash, so their order is the order of the hash.
    width = -(-(1 << 32) // slices)
    placed = segments.select(
        "*", number.alias("bucket"), bound.alias("bucket_tokens"),
        F.pmod(F.xxhash64("doc_id", "segment"), F.lit(1 << 32)).alias("_hash"),
    ).withColumn("_slice", F.expr(f"_hash DIV {width}"))
    sizes = placed.groupBy("bucket", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("bucket", "_slice").orderBy("_hash", "doc_id", "segment", "n_tokens")
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["bucket", "_slice"])
    room = F.expr(f"greatest(1, {budget} DIV greatest(bucket_tokens, 1))")
    place = F.col("_before") + F.col("_rank")
    return ranked.select(
        "doc_id", "segment", "first_token", "n_tokens", "bucket", "bucket_tokens",
        F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
