"""Exact n-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct 4-word shingles, as 64-bit hashes. Two sets
link when 100 * intersection >= 85 * union. With ``a(n) = ceil(0.85 n)``, linked
sets share at least ``a`` of the larger one, so if each set is cut to its first
``n - a(n) + e(n)`` tokens in one common order, the two cuts share at least the
smaller ``e`` of the two. This is used twice:

1. *Extended prefix.* In hash order, with a large ``e``. Only these tokens leave
   the documents' tasks, and their document counts are taken over all documents.
   A set with fewer than ``m(n) = e(a(n))`` tokens that occur elsewhere has no
   partner. ``a(n)`` is the smallest size a partner may have.
2. *Rarest first.* Within the extended prefix, tokens are put in order of their
   counts. Cuts to all but ``m(n) - k`` tokens share at least ``k``. Either a shared
   one is rare, and is indexed on its own, or all are frequent. Frequent tokens
   are dealt into ``k - 1`` classes by hash; two shared ones then fall into one
   class, so the combinations of two tokens of a class are indexed.

Every set also has a mark of MARK_BITS bits: each token flips one. Two marks differ
in at most as many bits as the sets have tokens that only one of them has, which
rules out most unlinked candidates before their texts are fetched.

Only links between different texts and different components matter, so texts
with equal sets are one class from the start, and two rounds first tie every set
to the most promising pivot of its tokens. Tokens whose sets are then all in one
component are dropped; what is left is joined exactly. Every candidate is
verified on both whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import SpanHash, by_size, doc_slices, join_ids, small_batches, text_bytes, whole, windows, written
from logharbor.llm.components import components

SHINGLE = 4
PERCENT = 85
# Tokens beyond the plain prefix: at least so many, or a sixteenth of the set.
EXTRA = 64
EXTRA_SHARE = 16
# Tokens of up to this many sets are indexed alone; of frequent ones, combinations are.
RARE = 16
# Fewest classes of frequent tokens; larger sets have one per sixteen tokens of their size class.
CLASSES = 3
CLASS_SHARE = 16
MARK_BITS = 1024
MARK = MARK_BITS // 64
# Rounds that only tie sets to pivots.
PIVOT_ROUNDS = 2


def least_overlap(n, percent: int = PERCENT):
    """Smallest overlap a set of ``n`` tokens can have with a linked set at least as large."""
    return -(-percent * n // 100)


def extra(n, percent: int = PERCENT):
    """Tokens of the extended prefix beyond the plain one; never falls as ``n`` grows."""
    return np.minimum(least_overlap(n, percent), np.maximum(n // EXTRA_SHARE, EXTRA))


def shingle_sets(spans: SpanHash, texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; fewer words than ``size`` are one shingle."""
    out = []
    for first, stop in by_size(texts):
        some = [t.lower() for t in texts[first:stop]]
        hashes, owners = spans.words(some)
        runs, bounds = windows(hashes, size), doc_slices(owners, len(some)).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= size:
                out.append(np.unique(runs[a:b - size + 1]))
            else:
                out.append(whole(hashes[a:b]) if b > a else hashes[:0])
    return out


def mark(tokens: np.ndarray) -> np.ndarray:
    """The set's mark: bit i is the parity of the number of its tokens that hash to i."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % MARK_BITS, minlength=MARK_BITS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(percent: int, size: int):
    def rows(batches):
        spans = SpanHash()
        for batch in batches:
            sets = shingle_sets(spans, batch.column("_text").to_pylist(), size)
            n = np.array([len(s) for s in sets], np.int64)
            cut = n - least_overlap(n, percent) + extra(n, percent)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            parts = [s[:k].view(np.int64) for s, k in zip(sets, cut.tolist(), strict=True)]
            marks = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([*map(mark, sets), np.zeros(0, np.int64)])), MARK)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(digests, pa.binary()), marks.cast(pa.list_(pa.int64())), tokens],
                names=["doc_id", "n_shingles", "digest", "mark", "tokens"])

    return rows


def prefixes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Per document: size and digest of its whole set, and its extended prefix in hash order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_text"))
    return rows.mapInArrow(_prefixes(percent, size), "doc_id bigint, n_shingles bigint, digest binary, mark array<bigint>, tokens array<bigint>")


def _ceil_percent(n: str, percent: int) -> str:
    return f"CAST(ceil({percent} * {n} / 100D) AS BIGINT)"


def _extra_sql(n: str, percent: int) -> str:
    return f"least({_ceil_percent(n, percent)}, greatest({n} DIV {EXTRA_SHARE}, {EXTRA}))"


def _alone(percent: int) -> int:
    """Sets of up to this size link to equal sets only."""
    return 99 // (100 - percent) - 1


def _octave(n: str) -> str:
    """Largest power of two up to n."""
    return f"CAST(shiftleft(1L, length(bin({n})) - 1) AS BIGINT)"


def _classes(octave: str, percent: int) -> str:
    """Classes of frequent tokens for sets of an octave of sizes; fewer than the tokens they surely share."""
    sure = _extra_sql(_ceil_percent(octave, percent), percent)
    return f"greatest({CLASSES}, least({sure} - 1, {octave} DIV {CLASS_SHARE}))"


def token_index(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, n, token, df): of each set that can have a partner, the tokens it is found by.

    Counts are partial per task before they move. The join that brings them back
    may split a token that most sets hold.
    """
    rows = sets.select(F.col("doc_id").alias("id"), F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    n = "n_shingles"
    cut = f"({n} - {_ceil_percent(n, percent)} + {_extra_sql(n, percent)})"
    need = _extra_sql(_ceil_percent(n, percent), percent)
    sizes = sets.select(F.col("doc_id").alias("id"), n, F.expr(f"CAST({cut} AS INT)").alias("cut"), F.expr(f"CAST({need} AS INT)").alias("need"))
    # Tokens that occur nowhere else come first in the order of counts and fill the prefix before shared ones.
    keep = f"CAST(least(size(shared), size(shared) - need + 1 + {_classes(_octave(n), percent)}) AS INT)"
    return (
        shared.join(sizes, "id").where(f"{n} > {_alone(percent)} AND size(shared) >= need")
        .select("id", F.col(n).alias("n"), F.explode(F.expr(f"slice(shared, 1, {keep})")).alias("t"))
        .select("id", "n", F.col("t.token").alias("token"), F.col("t.df").alias("df"))
    )


def _may_link(n1: str, mark1: str, n2: str, mark2: str, percent: int) -> Column:
    """Sizes and marks allow a link: the sets differ in (100 - p) / (100 + p) of both sizes' sum at most."""
    apart = " + ".join(f"bit_count({mark1}[{i}] ^ {mark2}[{i}])" for i in range(MARK))
    return F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) "
                  f"AND {100 + percent} * ({apart}) <= {100 - percent} * ({n1} + {n2})")


def pivot_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Per set, the pivot of another component that it shares most index tokens with.

    A token's pivots are its smallest member of each size class, so members are
    never listed against each other.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    rows = index.withColumn("band", band)
    heads = rows.groupBy("token", "band").agg(F.min(F.struct("id", "n", "comp")).alias("head"), F.max("comp").alias("_top")).where("head.comp < _top")
    met = rows.join(heads, ["token", "band"]).where("comp <> head.comp")
    return (
        met.groupBy("id", F.col("head.id").alias("b")).agg(F.count("*").alias("c"))
        .groupBy("id").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b")).select(F.col("id").alias("a"), "b")
    )


def with_marks(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and marks of ``marks(id, n, mark)`` leave possible."""
    first = marks.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("mark").alias("mark1"))
    second = marks.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("mark").alias("mark2"))
    return pairs.join(first, "a").join(second, "b").where(_may_link("n1", "mark1", "n2", "mark2", percent)).select("a", "b")


def combination_pairs(index: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets in different components that share a rare token or two frequent ones of a class.

    Keys whose sets are all in one component are dropped first; sizes and marks
    decide inside the join, so that only likely links leave it.
    """
    def mixed(rows: DataFrame, key: str) -> DataFrame:
        spread = rows.groupBy(key).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select(key)
        return rows.join(spread, key)

    rows = mixed(index, "token")
    rare = rows.where(F.col("df") <= RARE).select("id", "comp", F.col("token").alias("key"))
    often = rows.where(F.col("df") > RARE)
    # A linked set may belong to the octave below, so sets near their octave's lower end are indexed for that too.
    dealt = []
    for octave, sizes in ((_octave("n"), "true"), (f"{_octave('n')} DIV 2", f"{percent} * n <= 100 * {_octave('n')}")):
        classes = f"CAST({_classes('octave', percent)} AS BIGINT)"
        dealt.append(often.where(sizes).withColumn("octave", F.expr(octave)).select(
            "id", "comp", "token", F.expr(f"struct(octave, pmod(xxhash64(token), {classes}) AS part)").alias("class")))
    lists = dealt[0].unionByName(dealt[1]).groupBy("id", "comp", "class").agg(F.sort_array(F.collect_list("token")).alias("ts"))
    firsts = lists.select("id", "comp", "class", "ts", F.posexplode("ts").alias("i", "x"))
    both = firsts.select("id", "comp", "class", "x", F.explode(F.expr("slice(ts, i + 2, size(ts))")).alias("y"))
    frequent = mixed(both.select("id", "comp", F.xxhash64("class", "x", "y").alias("key")), "key")
    keyed = rare.unionByName(frequent.select("id", "comp", "key")).join(marks, "id")
    other = keyed.selectExpr("id AS id2", "n AS n2", "comp AS comp2", "mark AS mark2", "key")
    met = keyed.join(other, "key").where("id < id2 AND comp <> comp2").where(_may_link("n", "mark", "n2", "mark2", percent))
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _linked(percent: int, size: int):
    def rows(batches):
        spans = SpanHash()
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("_x", "_y"))
            # Pivots repeat: each distinct text is cut up once a batch.
            number = {t: i for i, t in enumerate(dict.fromkeys(left + right))}
            sets = shingle_sets(spans, list(number), size)
            keep = []
            for x, y in zip(left, right, strict=True):
                p, q = sets[number[x]], sets[number[y]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def verify(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The written pairs (a, b) whose whole texts link. Only texts of candidates move."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_text"))
    left = join_ids(texts, pairs.withColumnRenamed("a", "doc_id"), "doc_id").select(F.col("doc_id").alias("a"), "b", F.col("_text").alias("_x"))
    ends = written(pairs.select(F.col("b").alias("doc_id")).distinct(), "ends")
    right = join_ids(texts, ends, "doc_id").select(F.col("doc_id").alias("b"), F.col("_text").alias("_y"))
    return left.join(right, "b").select("a", "b", "_x", "_y").mapInArrow(_linked(percent, size), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Texts are whole; A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A text
    with fewer words than a shingle is one shingle; null and empty texts, and
    texts without words, have none and link to nothing. ``doc_id`` must be an
    integer and tell rows apart: rows with one id are taken as one document, the
    one whose set's digest is smallest; rows with a null id are left out. Other
    columns are not read. An empty table gives an empty result. ``percent`` is a
    whole number from 80 to 99: below that small sets share too few tokens.
    """
    if not 80 <= percent <= 99:
        raise ValueError(f"percent must be from 80 to 99, not {percent}")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    base = written(prefixes(docs, percent, size), "sets")
    same_id = base.groupBy("doc_id").agg(F.count("*").alias("c"), F.min(F.struct("digest", "n_shingles")).alias("first")).where("c > 1")
    if same_id.limit(1).count():
        only = written(same_id.select("doc_id", "first.digest"), "ids")
        base = written(base.join(only.withColumnRenamed("digest", "_d"), "doc_id", "left")
                       .where("_d IS NULL OR _d = digest").dropDuplicates(["doc_id"]).drop("_d"), "sets")
        docs = docs.join(only.select("doc_id"), "doc_id", "left_anti").unionByName(
            _first_text(docs.join(only, "doc_id"), percent, size))
    sized = base.where("n_shingles > 0")
    classes = written(sized.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # All but the first of each class of equal sets, found through the classes that have more than one.
    copies = written(
        sized.select("doc_id", "digest", "n_shingles").join(classes.where("copies > 1"), ["digest", "n_shingles"])
        .where("doc_id <> rep").select("doc_id", "rep"), "copies")
    reps = join_ids(sized, copies.select("doc_id"), "doc_id", "left_anti")
    index = written(token_index(reps, percent), "index")
    marks = written(base.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "mark")
                    .join(index.select("id").distinct(), "id", "left_semi"), "marks")
    links = None
    tied = index.withColumn("comp", F.col("id"))
    for _ in range(PIVOT_ROUNDS):
        found = written(verify(docs, written(with_marks(pivot_pairs(tied, percent), marks, percent), "pairs"), percent, size), "links")
        links = found if links is None else links.unionByName(found)
        joined = written(components(links), "components")
        tied = index.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    found = written(verify(docs, written(combination_pairs(tied, marks, percent), "pairs"), percent, size), "links")
    joined = components(links.unionByName(found)).withColumnRenamed("node", "rep")
    own = base.select("doc_id", "n_shingles").join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return own.join(joined, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _first_text(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Of rows that share an id, one whose set has the wanted digest."""
    def pick(batches):
        spans = SpanHash()
        for batch in batches:
            sets = shingle_sets(spans, [(t or "").encode() for t in batch.column("text").to_pylist()], size)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d
                    for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            yield batch.select(["doc_id", "text"]).filter(pa.array(same, pa.bool_()))

    return rows.select("doc_id", "text", "digest").mapInArrow(pick, "doc_id bigint, text string").dropDuplicates(["doc_id"])
