"""Benchmark passages in training texts: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import SpanHash, by_size, doc_slices, small_batches, text_bytes, windows

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
# Share of the score of an exact copy of the whole item that makes a hit.
MIN_SHARE = 0.5
# Words of benchmark text held by a task at once; a larger benchmark goes in several such blocks.
BLOCK_WORDS = 1_000_000
# Places of items looked at side by side while texts are compared with them.
SLICE_PLACES = 1_000_000


class Grams:
    """All n-grams of one length of a block of items: the distinct ones, sorted, and the items that hold each."""

    def __init__(self, size: int, words: list[np.ndarray], items: list[int]) -> None:
        self.size = size
        each = [windows(words[i], size) for i in items]
        flat = np.concatenate([*each, np.zeros(0, np.uint64)])
        owner = np.repeat(np.array(items, np.int64), [len(g) for g in each])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.all, self.first, self.places = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = Bits(self.all)

    def held(self, hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, gram) of the grams each text holds, sorted and without repeats."""
        if len(hashes) < self.size:
            return (np.zeros(0, np.int64),) * 2
        grams = windows(hashes, self.size)
        at = self.bits.where(grams)
        at = at[owners[at] == owners[at + self.size - 1]]
        each = np.unique(owners[at] * len(self.all) + np.searchsorted(self.all, grams[at]))
        return each // max(1, len(self.all)), each % max(1, len(self.all))

    def shared(self, hashes: np.ndarray, owners: np.ndarray, least: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) where the text holds the n-grams of at least ``least[item]`` places of the item."""
        docs, grams = self.held(hashes, owners)
        sums, out, a = np.cumsum(self.places[grams]), [], 0
        while a < len(docs):
            # Whole texts at a time; one text meets each place of the block once at most.
            done = int(sums[a - 1]) if a else 0
            last = min(len(docs) - 1, int(np.searchsorted(sums, done + SLICE_PLACES)))
            b = int(np.searchsorted(docs, docs[last]))
            b = b if b > a else int(np.searchsorted(docs, docs[a], "right"))
            b = len(docs) if last == len(docs) - 1 and sums[-1] - done <= SLICE_PLACES else b
            n = self.places[grams[a:b]]
            at = np.arange(n.sum()) + np.repeat(self.first[grams[a:b]] - np.cumsum(n) + n, n)
            key, count = np.unique(np.repeat(docs[a:b], n) * len(least) + self.owner[at], return_counts=True)
            key = key[count >= least[key % len(least)]]
            out += zip((key // len(least)).tolist(), (key % len(least)).tolist(), strict=True)
            a = b
        return out


class Item:
    """What one item's copies are looked for by, in a single text."""

    def __init__(self, words: np.ndarray, size: int, least_pairs: int) -> None:
        self.words, self.size, self.least_pairs = words, min(size, len(words)), least_pairs
        self.kinds, self.counts = np.unique(words, return_counts=True)
        self.grams = [self._table(n) for n in sorted({self.size, 2} if least_pairs else {self.size})]

    def _table(self, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        grams = windows(self.words, size)
        kinds, first, counts = np.unique(grams, return_index=True, return_counts=True)
        last = len(grams) - 1 - np.unique(grams[::-1], return_index=True)[1]
        return size, kinds, counts, first, last

    def seeds(self, text: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, place in the text, gram, places of it in the item, first and last of them) of the seeds, by size."""
        out = []
        for size, kinds, counts, first, last in self.grams:
            grams = windows(text, size)
            at = np.minimum(np.searchsorted(kinds, grams), len(kinds) - 1)
            where = np.flatnonzero(kinds[at] == grams)
            which = at[where]
            out.append((size, where, which, counts[which], first[which], last[which]))
        return out

    def enough(self, seeds: list, a: int, b: int) -> bool:
        """Whether the words from ``a`` to ``b`` hold a whole n-gram, or pairs of enough places of the item."""
        for size, where, which, counts, _, _ in seeds:
            lo, hi = np.searchsorted(where, (a, b - size + 1))
            if lo < hi and (size == self.size or counts[lo:hi][np.unique(which[lo:hi], return_index=True)[1]].sum() >= self.least_pairs):
                return True
        return False

    def common(self, region: np.ndarray) -> int:
        """Words of the item that the region holds, in any order: no alignment matches more."""
        at = np.minimum(np.searchsorted(self.kinds, region), len(self.kinds) - 1)
        return int(np.minimum(np.bincount(at[self.kinds[at] == region], minlength=len(self.kinds)), self.counts).sum())


class Items:
    """Words and n-grams of a block of test items."""

    def __init__(self, rows: list[tuple[int, bytes]], size: int, min_share: float) -> None:
        spans = SpanHash()
        self.ids = [i for i, _ in rows]
        hashes, owners = spans.words([t.lower() for _, t in rows])
        cuts = doc_slices(owners, len(rows)).tolist()
        self.words = [hashes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        lengths = np.array([len(w) for w in self.words], np.int64)
        # Runs of at most two intact words, x of two and y of one, have x + y - 1 edits between
        # them. Where none of these is an insertion, 3x + 2y <= n + 1, and a score of
        # 2n * min_share needs 3x + y >= 2n * min_share - 1.
        pairs = np.ceil((4 * min_share * lengths - lengths - 3) / 3 - 1e-9).astype(np.int64)
        self.least_pairs = np.where(lengths > size, np.maximum(pairs, size), 0) if size > 2 else np.zeros_like(lengths)
        # An item shorter than an n-gram is one seed of its own length.
        own = np.minimum(lengths, size)
        self.grams = [(Grams(n, self.words, np.flatnonzero(own == n).tolist()), np.ones_like(lengths)) for n in sorted({*own.tolist()} - {0})]
        if self.least_pairs.any():
            self.grams.append((Grams(2, self.words, np.flatnonzero(self.least_pairs).tolist()), self.least_pairs))
        self.size, self.items = size, {}

    def item(self, i: int) -> Item:
        if i not in self.items:
            if len(self.items) > 8192:
                self.items.clear()
            self.items[i] = Item(self.words[i], self.size, int(self.least_pairs[i]))
        return self.items[i]


class Bits:
    """Fast test of many hashes against a sorted few."""

    def __init__(self, some: np.ndarray) -> None:
        self.some = some
        self.table = np.zeros(1 << 20, bool)
        self.table[(some >> np.uint64(44)).astype(np.int64)] = True

    def where(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of members."""
        if not len(self.some):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.some, hashes[maybe])
        return maybe[(at < len(self.some)) & (self.some[np.minimum(at, len(self.some) - 1)] == hashes[maybe])]


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, first and past-last word of the region.

    Cells of one antidiagonal depend on the two before it only, so each
    antidiagonal is one step. Of equal scores the one ending first wins.
    """
    n, m = len(item), len(region)
    best = (0, 0, 0)
    # Index i holds the cell (i, d - i); begins hold the region word an alignment begins with.
    before, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    b_before, b_last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        j = d - i
        diagonal = before[i - 1] + np.where(item[i - 1] == region[j - 1], MATCH, MISMATCH)
        begin = np.where(before[i - 1] > 0, b_before[i - 1], j - 1)
        up, left = last[i - 1] + GAP, last[i] + GAP
        score = np.maximum(np.maximum(diagonal, 0), np.maximum(up, left))
        begin = np.where(score == diagonal, begin, np.where(score == up, b_last[i - 1], b_last[i]))
        now, b_now = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        now[i], b_now[i] = score, begin
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(begin[top]), int(j[top]))
        before, last, b_before, b_last = last, now, b_last, b_now
    return best


def _parts(item: Item, seeds: list, n: int, min_share: float) -> list[tuple[int, int]]:
    """Parts of the text that copies with these seeds can cover, merged, then cut into overlapping parts."""
    length = len(item.words)
    # A copy of that score has fewer insertions than this.
    slack = int(2 * length * (1 - min_share)) + 2
    begin = np.concatenate([where - last for _, where, _, _, _, last in seeds])
    end = np.concatenate([where - first for _, where, _, _, first, _ in seeds])
    order = np.argsort(begin, kind="stable")
    begin, end = np.maximum(begin[order] - slack, 0), np.minimum(np.maximum.accumulate(end[order]) + length + slack, n)
    cuts = np.flatnonzero(begin[1:] > end[:-1]) + 1
    out = []
    # A text full of seeds is aligned in overlapping parts, so memory follows the item.
    step, over = 4 * length + 64, length + slack
    for a, b in zip(begin[[0, *cuts]].tolist(), end[[*(cuts - 1), -1]].tolist(), strict=True):
        out += [(x, min(b, x + step + over)) for x in range(a, max(a + 1, b - over), step)]
    return out


def _find(items: Items, min_share: float):
    def rows(batches):
        spans = SpanHash()
        for batch in batches:
            texts, ids = batch.column("_text").to_pylist(), batch.column("doc_id").to_pylist()
            out = []
            for first, stop in by_size(texts):
                hashes, owners = spans.words([t.lower() for t in texts[first:stop]])
                pairs = {pair for grams, least in items.grams for pair in grams.shared(hashes, owners, least)}
                cuts = doc_slices(owners, stop - first) if pairs else None
                for doc, number in sorted(pairs):
                    item, text = items.item(number), hashes[cuts[doc]:cuts[doc + 1]]
                    seeds, best = item.seeds(text), (0, 0, 0)
                    for a, b in _parts(item, seeds, len(text), min_share):
                        if not item.enough(seeds, a, b) or item.common(text[a:b]) < min_share * len(item.words) - 1e-9:
                            continue
                        score, begin, end = align(item.words, text[a:b])
                        if score > best[0]:
                            best = (score, a + begin, a + end)
                    share = best[0] / (MATCH * len(item.words))
                    if share >= min_share:
                        n_seeds = sum(int(counts.sum()) for size, _, _, counts, _, _ in seeds if size == item.size)
                        out.append((ids[first + doc], items.ids[number], share, n_seeds, best[1], best[2]))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["doc_id", "item_id", "score", "n_seeds", "word_from", "word_to"])

    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SEED_WORDS,
                 min_share: float = MIN_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, word_from, word_to) of every document that holds a copy of an item.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Every n-gram of an item is a
    seed: a text with one of them is aligned to the item around it. So is a text without
    one that holds as many pairs of neighbouring words of the item as a copy of that score
    with replaced or dropped words must, and at least ``size`` of them. Texts around seeds
    with too few of the item's words for that score are not aligned. ``score`` is the
    alignment's score as a share of an exact copy's, the best of the text; ``n_seeds``
    counts intact n-grams. Whole texts are read where they lie; only hits leave the tasks.
    Not sought are copies whose intact words never stand three together and, by words put
    in between, seldom two together.

    Null and empty texts and items hold nothing; items shorter than an n-gram
    are their own seed. Repeated rows give repeated hits; ties go to the first
    place in the text. Other columns are not read. An item that has no words
    never hits. Empty tables give an empty result. Items go to the tasks in
    blocks of at most ``block_words`` words and one item.
    """
    kind, spark = dict(docs.dtypes)["doc_id"], docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", text_bytes().alias("_text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("_text")).where("item_id IS NOT NULL")
    words = items.select(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    blocks = max(1, -(-words // (5 * block_words)))
    schema = f"doc_id {kind}, item_id bigint, score double, n_seeds bigint, word_from bigint, word_to bigint"
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "_text"), F.lit(blocks)) == block) if blocks > 1 else items
        held = Items(sorted((r.item_id, bytes(r._text)) for r in part.collect()), size, min_share)
        found = rows.mapInArrow(_find(held, min_share), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)
