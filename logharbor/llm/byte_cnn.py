"""Quality classifier: a convolutional network over bytes, in numpy.

A text's bytes are embedded and cut into blocks of STRIDE bytes. Filters see WIDTH
bytes, so neighbouring chunks overlap and together cover the whole text. Each
filter's largest response over the text feeds a hidden layer and one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import crc_mod, small_batches, text_bytes, written

STRIDE = 8
SPAN = 3  # blocks a filter sees
WIDTH = STRIDE * SPAN
EMBED = 8
FILTERS = 40
HIDDEN = 16
PAD = 256
# Bound of the fit: labelled texts of each label, bytes of all of them, and of one.
FIT_TEXTS = 1_500
FIT_BYTES = 16_000_000
FIT_TEXT_BYTES = FIT_BYTES // 16
EPOCHS = 8
BATCH = 32
RATE = 4e-3
THRESHOLD = 0.3
# Bytes of text scored at once; a longer text is scored in such pieces that overlap by a chunk.
PIECE = 1 << 18


class ByteNet:
    """Parameters and passes of the network; pickles to a few dozen kilobytes."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        inputs = WIDTH * EMBED
        self.w = {
            "embed": draw.normal(0, 0.5, (PAD + 1, EMBED)),
            "filters": draw.normal(0, np.sqrt(2 / inputs), (inputs, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": draw.normal(0, np.sqrt(2 / FILTERS), (FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.w["embed"][PAD] = 0
        self.prior = 0.0

    @staticmethod
    def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, each padded to whole blocks and one chunk at least; first block of each."""
        blocks = [max(SPAN, -(-len(t) // STRIDE)) for t in texts]
        first = np.concatenate(([0], np.cumsum(blocks)))
        codes = np.full(int(first[-1]) * STRIDE, PAD, np.int64)
        for t, b in zip(texts, first, strict=False):
            codes[b * STRIDE:b * STRIDE + len(t)] = np.frombuffer(t, np.uint8)
        return codes, first

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses of the chunk that begins at each block."""
        flat = self.w["embed"][codes].reshape(-1, STRIDE * EMBED)
        parts = self.w["filters"].reshape(SPAN, STRIDE * EMBED, FILTERS).transpose(1, 0, 2).reshape(STRIDE * EMBED, -1)
        each = flat @ parts
        n = len(each) - SPAN + 1
        out = each[:n, :FILTERS].copy()
        for k in range(1, SPAN):
            out += each[k:k + n, k * FILTERS:(k + 1) * FILTERS]
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        codes, first = self.lay_out(texts)
        got = self.responses(codes)
        return np.stack([got[a:b - SPAN + 1].max(0) for a, b in zip(first, first[1:], strict=False)])

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = np.maximum(pooled + self.w["bias"], 0)
        hidden = np.maximum(seen @ self.w["hidden"] + self.w["hidden_bias"], 0)
        return seen, hidden, hidden @ self.w["out"] + self.w["out_bias"][0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each whole text; an empty one is all padding."""
        pooled = np.full((len(texts), FILTERS), -np.inf, np.float32)
        for owners, pieces in self.groups(texts):
            np.maximum.at(pooled, owners, self.pooled(pieces))
        return 1 / (1 + np.exp(-(self.head(pooled)[2].astype(np.float64) + self.prior)))

    @staticmethod
    def groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """Pieces of texts, up to PIECE bytes at once; pieces of one text overlap so that no chunk is lost."""
        owners, pieces, size = [], [], 0
        for i, text in enumerate(texts):
            for a in range(0, max(1, len(text) - (WIDTH - STRIDE)), PIECE):
                piece = text[a:a + PIECE + WIDTH - STRIDE]
                if pieces and size + len(piece) > PIECE:
                    yield owners, pieces
                    owners, pieces, size = [], [], 0
                owners.append(i)
                pieces.append(piece)
                size += len(piece)
        if pieces:
            yield owners, pieces

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; through the maximum, only the winning chunks of each filter learn."""
        codes, first = self.lay_out(texts)
        got = self.responses(codes)
        at = np.stack([a + got[a:b - SPAN + 1].argmax(0) for a, b in zip(first, first[1:], strict=False)])
        seen, hidden, logit = self.head(np.take_along_axis(got, at, 0) if len(at) else got[:0])
        off = ((1 / (1 + np.exp(-logit)) - labels) / len(texts)).astype(np.float32)
        back = np.outer(off, self.w["out"]) * (hidden > 0)
        pool = (back @ self.w["hidden"].T) * (seen > 0)
        which = codes[at[:, :, None] * STRIDE + np.arange(WIDTH)]
        inputs = self.w["embed"][which].reshape(*at.shape, -1)
        embed = np.zeros_like(self.w["embed"])
        to_inputs = pool[:, :, None] * self.w["filters"].T[None]
        np.add.at(embed, which.ravel(), to_inputs.reshape(-1, EMBED))
        embed[PAD] = 0
        return {
            "embed": embed, "filters": np.einsum("df,dfi->if", pool, inputs), "bias": pool.sum(0),
            "hidden": seen.T @ back, "hidden_bias": back.sum(0), "out": hidden.T @ off, "out_bias": off.sum(keepdims=True),
        }

    def fit(self, texts: list[bytes], labels: list[int], true_share: float, epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
        """Adam over shuffled batches; the output is then set to the share of label 1 among all labels."""
        draw = np.random.default_rng(seed)
        labels = np.array(labels, np.float32)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = draw.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                some = order[a:a + BATCH]
                step += 1
                rate = RATE * (1 - 0.9 * step / total)
                for k, g in self.gradients([texts[i] for i in some], labels[some]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.w[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)
        share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
        true_share = min(max(true_share, 1e-3), 1 - 1e-3)
        self.prior = float(np.log(true_share / (1 - true_share)) - np.log(share / (1 - share)))
        return self


def fit_sample(docs: DataFrame, labels: DataFrame, texts: int = FIT_TEXTS) -> tuple[list[bytes], list[int], float]:
    """Bounded training sample: ``texts`` of each label by hash of the id, whole; and label 1's share of all labels.

    Texts of more than FIT_TEXT_BYTES are left out, each alone, so that no single one
    can fill the sample; the others enter by their hash up to FIT_BYTES together.

    Ids with a null label teach nothing; of an id labelled twice the smaller label counts.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = one.agg(F.avg("quality")).first()[0]
    # An ordered limit keeps the first rows of each task, so no task reads the ids of a whole label.
    first = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts) for q in (0, 1)]
    picked = first[0].unionByName(first[1])
    # ``picked`` has at most two rows per unit of the bound.
    short = docs.select("doc_id", text_bytes().alias("_text")).where(F.octet_length("_text") <= FIT_TEXT_BYTES)
    rows = written(short.join(F.broadcast(picked), "doc_id"), "labelled")
    # Texts that would take the sample beyond FIT_BYTES are left out, largest hash first.
    so_far = Window.orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", F.octet_length("_text").alias("_size"), F.xxhash64("doc_id").alias("_h"))
    fits = sizes.withColumn("_sum", F.sum("_size").over(so_far)).where(F.col("_sum") <= FIT_BYTES).select("doc_id")
    got = rows.join(F.broadcast(fits.distinct()), "doc_id", "left_semi").collect()
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r._text)))
    return [bytes(r._text) for r in got], [r.quality for r in got], 0.5 if share is None else float(share)


def score(docs: DataFrame, net: ByteNet, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score`` of every whole text beside the kept columns; null and empty texts are scored as padding."""
    def rows(batches):
        for batch in batches:
            values = pa.array(net.scores(batch.column("_text").to_pylist()) if batch.num_rows else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], names=[*keep, "score"])

    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(rows, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from labelled ids whose crc32(id as text) mod 5 is not 0. Only text
    bytes enter the network. Without any labels the scores are those of an
    untrained network. Repeated rows are scored alike; rows with a null id are
    scored and not held out; other columns are not read.
    """
    texts, marks, share = fit_sample(docs, labels.where(crc_mod("doc_id", 5) != 0))
    net = ByteNet().fit(texts, marks, share)
    marked = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    return score(marked, net, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
