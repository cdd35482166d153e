"""Quality rules from how a public vocabulary splits a text."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import SpanHash, by_size, doc_slices, small_batches, text_bytes, windows, written
from logharbor.llm.tokenizers import PIECES, WordIds, piece_encoder, read_file

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\f\r"
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
# A text's token entropy is held against what its length allows, and at most this many bits.
FULL_ENTROPY = 8.0
# Bands reach this many interquartile ranges beyond the quartiles, and a least share of the median.
FENCE = 3.0
LEAST_WIDTH = {"chars_per_token": 0.25, "entropy_share": 0.25}
LEAST_BYTE_SHARE = 0.05
# Prefix of the groups of texts without a language, which their script names.
SCRIPT_GROUP = "script:"
# Quartiles of few texts are uncertain: bands of n texts are wider by the share WIDEN / n.
WIDEN = 10.0

FEATURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, n_byte_tokens bigint, entropy double"
)


def _repeated_words(hashes: np.ndarray, owners: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in it."""
    size = REPEAT_WINDOW
    if len(hashes) < size:
        return np.zeros(texts, np.int64)
    at = np.flatnonzero(owners[: len(owners) - size + 1] == owners[size - 1:])
    with np.errstate(over="ignore"):
        keys = windows(hashes, size)[at] + owners[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, at[again], 1)
    np.add.at(steps, at[again] + size, -1)
    return np.bincount(owners[np.cumsum(steps)[:-1] > 0], minlength=texts)


class Scripts(dict):
    """Script of each letter: the first word of its Unicode name; empty for what is no letter."""

    def __missing__(self, point: int) -> str:
        letter = chr(point)
        self[point] = unicodedata.name(letter, "").split(" ")[0] if letter.isalpha() else ""
        return self[point]

    def dominant(self, text: str) -> str:
        """The script of most letters of a text, the first by name of equals; empty without letters."""
        points, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
        totals: dict[str, int] = {}
        for point, n in zip(points.tolist(), counts.tolist(), strict=True):
            if name := self[point]:
                totals[name] = totals.get(name, 0) + n
        return min(totals, key=lambda name: (-totals[name], name), default="")


def _features(model: bytes):
    def rows(batches):
        encode, is_byte = piece_encoder(model)
        ids, spans, scripts = WordIds(encode), SpanHash(), Scripts()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            out = {name: [] for name in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "n_tokens", "n_byte_tokens", "entropy")}
            for first, stop in by_size(texts):
                some = texts[first:stop]
                hashes, owners = spans.words(some)
                out["n_words"] += np.diff(doc_slices(owners, len(some))).tolist()
                out["n_repeat_words"] += _repeated_words(hashes, owners, len(some)).tolist()
                for text in some:
                    out["word_chars"].append(
                        len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in SPACES))
                    out["n_symbols"].append(sum(text.count(c) for c in SYMBOLS))
                    lines = [x for x in text.split(b"\n") if x.strip()]
                    out["n_dup_lines"].append(len(lines) - len(set(lines)))
                    tokens = np.frombuffer(ids.of(text.split()), "<u2")
                    counts = np.bincount(tokens)
                    counts = counts[counts > 0]
                    out["n_tokens"].append(len(tokens))
                    out["n_byte_tokens"].append(int(is_byte[tokens].sum()))
                    out["entropy"].append(
                        float(np.log2(len(tokens)) - (counts * np.log2(counts)).sum() / len(tokens)) if len(tokens) else 0.0)
            groups = [SCRIPT_GROUP + scripts.dominant(t.decode("utf-8", "replace")) if g is None else g
                      for g, t in zip(batch.column("_group").to_pylist(), texts, strict=True)]
            kept = [batch.column("doc_id"), pa.array(groups, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(v, pa.float64() if k == "entropy" else pa.int64()) for k, v in out.items())],
                names=["doc_id", "_group", *out])

    return rows


def measure(docs: DataFrame, group: str = "lang", model_path: str = PIECES) -> DataFrame:
    """Counts of every whole text, one row per input row: doc_id, _group and FEATURES.

    Words are ``[^\\x20\\x09-\\x0D]+``; each is split into pieces as if after a
    space. Null and empty texts have zeros. A row without a group belongs to that of
    its text's dominant script.
    Repeated rows give repeated rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = read_file(docs.sparkSession, model_path)
    rows = docs.select("doc_id", F.col(group).cast("string").alias("_group"), text_bytes().alias("_text"))
    return rows.mapInArrow(_features(model), f"doc_id {dict(docs.dtypes)['doc_id']}, _group string, {FEATURES}")


def with_rates(measured: DataFrame) -> DataFrame:
    """Characters per token, byte share, entropy share and the base verdict."""
    return measured.withColumns({
        "chars_per_token": F.expr("word_chars / nullif(n_tokens, 0)"),
        "byte_share": F.expr("n_byte_tokens / nullif(n_tokens, 0)"),
        "entropy_share": F.expr(f"entropy / greatest(least(log2(greatest(n_tokens, 1)), {FULL_ENTROPY}D), 1D)"),
        "base_failed": F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"),
    })


def bands(rated: DataFrame) -> DataFrame:
    """One row of limits per group, from all its texts that pass the base rules, however few.

    Quartiles come from ``percentile_approx`` at accuracy 10,000, which merges
    per-task sketches, so one group holding most rows is no hot spot.
    """
    values = [*LEAST_WIDTH, "byte_share"]
    quartiles = [F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000).alias(v) for v in values]
    each = rated.where("NOT base_failed").groupBy("_group").agg(F.count("*").alias("_n"), *quartiles)
    more, limits = f"({WIDEN}D / _n)", []
    for v, share in LEAST_WIDTH.items():
        width = f"(1D + {more}) * greatest({FENCE}D * ({v}[2] - {v}[0]), {share}D * {v}[1])"
        limits += [F.expr(f"{v}[1] - {width}").alias(f"{v}_low"), F.expr(f"{v}[1] + {width}").alias(f"{v}_high")]
    width = f"(1D + {more}) * {FENCE}D * (byte_share[2] - byte_share[0])"
    high = f"greatest((1D + {more}) * byte_share[2] + {width}, {LEAST_BYTE_SHARE}D)"
    return each.select("_group", *limits, F.expr(high).alias("byte_share_high"))


def fertility_rules(docs: DataFrame, group: str = "lang", model_path: str = PIECES) -> DataFrame:
    """Counts, rates, limits and verdict of every document.

    Base rules: at least 20 words, and at most 30 percent of the words inside
    8-word windows that repeat. A text that passes is kept when its characters
    per token and entropy share lie within its group's bands and its byte
    share is not above it. Bands come from the whole input, each group's from its
    own texts, wider the fewer these are; a group without a passing text has none.
    The group is the language, and for rows without one the script of most of the
    text's letters.
    Empty input gives an empty result. The counts are written once and read twice.
    """
    rated = with_rates(written(measure(docs, group, model_path), "fertility"))
    limits = written(bands(rated), "bands")
    # One row per language is few; past the count the join is a plain one.
    few = limits.limit(10_001).count() <= 10_000
    joined = rated.join(F.broadcast(limits) if few else limits, "_group", "left")
    inside = F.lit(True)
    for name in [c for c in limits.columns if c != "_group"]:
        value, side = name.rsplit("_", 1)
        inside = inside & (F.col(value) >= F.col(name) if side == "low" else F.col(value) <= F.col(name))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_group")
