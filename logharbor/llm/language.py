"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import crc_mod, small_batches

# Bound of the fit: characters of labelled text per language, texts looked at for them, and characters of one text.
FIT_CHARS = 16_000
FIT_TEXTS = 100
FIT_TEXT_CHARS = 2_000
# Texts are parsed in blocks of this many symbols; a phrase ends where a block ends.
BLOCK = 2_048
# Blocks parsed side by side.
LANES = 4_096
UNKNOWN = "und"
# Letters of a language's own in its automaton, the commonest; and the bound of all tables that go to every task, in half entries of four bytes.
MOST_LETTERS = 512
MOST_ENTRIES = 1 << 28


def symbols(text: str) -> str:
    """Lower-cased letters, every run of other characters as one space, one space at both ends."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


class Letters:
    """Symbols as numbers: 0 is the space, the last one any letter not seen in the fit."""

    def __init__(self, texts: list[str]) -> None:
        seen = sorted(set("".join(texts)) - {" "})
        self.size = len(seen) + 2
        self.letters = {c: i + 1 for i, c in enumerate(seen)}
        # Number of every code point; -1 where lower-casing gives several characters.
        self.table = np.zeros(0x110000, np.int16)
        for point in range(0x110000):
            low = chr(point).lower()
            if len(low) > 1:
                self.table[point] = -1
            elif low.isalpha():
                self.table[point] = self.letters.get(low, self.size - 1)

    def encode(self, text: str) -> np.ndarray:
        """Numbers of ``symbols(text)``."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.table[points]
        if (out < 0).any():
            out = np.array([self.letters.get(c, self.size - 1) if c.isalpha() else 0 for c in text.lower()], np.int16)
        out = np.concatenate((np.zeros(1, np.int16), out, np.zeros(1, np.int16)))
        return out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))]


def suffix_automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions [state, symbol] of the smallest automaton of all substrings; -1 where none.

    State 0 is the empty substring. Built online in time linear in the text.
    """
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text.tolist():
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    table = np.full((len(step), size), -1, np.int32)
    for state, edges in enumerate(step):
        for c, to in edges.items():
            table[state, c] = to
    return table


class Parsers:
    """One total automaton per language.

    Where the automaton has no way on, the phrase ends and the symbol begins the
    next one; a symbol the language never has is a phrase of its own. Entries are
    the next row's offset, with the lowest bit set where a phrase ended.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        self.letters = Letters(list(texts.values()))
        tables, roots, maps, base = [], [], [], 0
        for lang in self.langs:
            encoded = self.letters.encode(texts[lang])
            # Each language has its own alphabet: 0, its commonest letters, one symbol for its rarer ones, one for letters it never has.
            counts = np.bincount(encoded, minlength=self.letters.size)
            counts[0] = 0
            own = np.argsort(-counts, kind="stable")[: min(MOST_LETTERS, np.count_nonzero(counts))]
            size = len(own) + 3
            local = np.where(counts > 0, size - 2, size - 1).astype(np.int32)
            local[0], local[own] = 0, np.arange(1, len(own) + 1)
            table = suffix_automaton(local[encoded], size)
            begin = np.maximum(table[0], 0)
            ended = table < 0
            table = np.where(ended, begin, table).astype(np.int64) * size + base
            if (base + table.size) * 2 > MOST_ENTRIES:
                raise ValueError(f"automata of {self.langs} are too large; lower FIT_CHARS")
            tables.append((table * 2 + ended).astype(np.int32))
            roots.append(base * 2)
            maps.append(local)
            base += table.size
        self.next = np.concatenate([t.ravel() for t in tables]) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        self.maps = np.stack(maps) if maps else np.zeros((0, self.letters.size), np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases [text, language] of each encoded text, blocks side by side."""
        owner = [i for i, t in enumerate(texts) for _ in range(0, len(t), BLOCK)]
        blocks = [t[a:a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        for first in range(0, len(blocks), LANES):
            lanes = order[first:first + LANES]
            sizes = np.array([len(blocks[i]) for i in lanes])
            grid = np.zeros((sizes[0], len(lanes)), np.int32)
            for col, i in enumerate(lanes):
                grid[: sizes[col], col] = blocks[i]
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
            count = np.zeros((len(self.langs), len(lanes)), np.int32)
            state = np.repeat(self.roots[:, None], len(lanes), 1)
            for at in range(sizes[0]):
                n = active[at]
                got = self.next[(state[:, :n] >> 1) + self.maps[:, grid[at, :n]]]
                count[:, :n] += got & 1
                state[:, :n] = got & -2
            # The phrase a block ends in counts as well.
            np.add.at(out, [owner[i] for i in lanes], count.T + 1)
        return out


def fit_texts(docs: DataFrame, lang: str = "lang", texts: int = FIT_TEXTS) -> dict[str, str]:
    """Labelled text per language: a bounded sample by hash, of each picked text a piece of its words from anywhere in it.

    Rows without language or text, and texts without any letter, teach nothing.
    ``row_number() <= n`` is cut down within each task before rows move.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("_lang"), F.xxhash64("doc_id", "text").alias("_h"), F.col("text").cast("string").alias("_whole"))
    first = Window.partitionBy("_lang").orderBy("_h", "_whole")
    picked = usable.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= texts)
    words = F.regexp_replace("_whole", r"[^\p{L}]+", " ")
    begin = F.expr(f"1 + pmod(_h, greatest(char_length(_words) - {FIT_TEXT_CHARS} + 1, 1))").cast("int")
    picked = picked.select("_lang", "_n", "_h", words.alias("_words")).select("_lang", "_n", F.col("_words").substr(begin, F.lit(FIT_TEXT_CHARS)).alias("_text"))
    out: dict[str, str] = {}
    for row in sorted(picked.collect(), key=lambda r: (r._lang, r._n)):
        have = out.get(row._lang, "")
        if len(have) < FIT_CHARS:
            out[row._lang] = (have + symbols(row._text))[:FIT_CHARS]
    return out


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``lang_pred`` and ``score`` added to every row, from the whole text.

    The language whose automaton parses the text into the fewest phrases per
    symbol wins; ties go to the name that sorts first. The score is the share by
    which the runner-up needs more phrases, from 0 (tie) to 1; with one learned
    language it is 1. Texts that are null or have no letter, and any text when
    nothing was learned, give ``und`` and 0. Row order within a task and all
    other columns stay.
    """
    small_batches(docs.sparkSession)
    parsers = Parsers(texts)
    n = len(parsers.langs)

    def predict(text: pd.Series) -> pd.DataFrame:
        names, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        encoded = [parsers.letters.encode(t) if t else np.zeros(0, np.int16) for t in text]
        some = [i for i, e in enumerate(encoded) if n and len(e) and e.any()]
        for first in range(0, len(some), 2_000):
            part = some[first:first + 2_000]
            counts = parsers.phrases([encoded[i] for i in part])
            best = counts.argmin(1)
            least = np.take_along_axis(counts, best[:, None], 1)[:, 0]
            names[part] = np.array(parsers.langs, object)[best]
            if n > 1:
                second = np.partition(counts, 1, axis=1)[:, 1]
                scores[part] = 1 - least / second
            else:
                scores[part] = 1.0
        return pd.DataFrame({"lang_pred": names, "score": scores})

    schema = "struct<lang_pred:string,score:double>"
    # Marked so that a filter on the result does not make Spark parse every text twice.
    udf = F.pandas_udf(predict, schema).asNondeterministic()
    return docs.withColumn("_id", udf(F.col("text").cast("string"))).withColumns(
        {"lang_pred": F.col("_id.lang_pred"), "score": F.col("_id.score")}).drop("_id")


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))


def language_of(docs: DataFrame) -> DataFrame:
    """Fit on rows that are not held out, predict for all: doc_id, held_out, lang_pred, score."""
    marked = held_out(docs)
    texts = fit_texts(marked.where("NOT held_out"))
    return identify(marked.select("doc_id", "held_out", "text"), texts).drop("text")
