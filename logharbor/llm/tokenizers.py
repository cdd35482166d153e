"""Public vocabularies, read through Spark and sent to the tasks as bytes."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

FOLDER = "file:///opt/tokenizers"
PIECES = f"{FOLDER}/piece_bpe_32k.model"
RANKS = f"{FOLDER}/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of the rank files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words remembered by a task at once, and the longest one remembered.
CACHE_WORDS = 300_000
CACHE_WORD_BYTES = 64


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, from any place Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def piece_encoder(model: bytes) -> tuple[Callable[[list[bytes]], dict[bytes, bytes]], np.ndarray]:
    """Encoder of words to their piece ids (uint16 bytes), and which ids are byte fallbacks."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = pieces.get_piece_size()
    begins = np.array([pieces.id_to_piece(i).startswith("\u2581") for i in range(n)])

    def encode(words: list[bytes]) -> dict[bytes, bytes]:
        """All words in one call; a piece that begins with the space mark begins a word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = np.array(pieces.encode(" ".join(texts), num_threads=1), "<u2")
        at = np.flatnonzero(begins[ids])
        if len(at) != len(words) or len(words) and at[0]:
            return {w: np.array(pieces.encode(t, num_threads=1), "<u2").tobytes() for w, t in zip(words, texts, strict=True)}
        raw, ends = ids.tobytes(), [*(2 * at[1:]).tolist(), 2 * len(ids)]
        return {w: raw[i:j] for w, i, j in zip(words, (2 * at).tolist(), ends, strict=True)}

    return encode, np.array([pieces.is_byte(i) or pieces.is_unknown(i) for i in range(n)])


def rank_encoder(ranks: bytes) -> Callable[[str], np.ndarray]:
    """Encoder of whole texts to the ids of a rank file."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={}).encode_ordinary


class WordIds(dict):
    """Word -> id bytes; asks the encoder for unseen words, in one call per text."""

    def __init__(self, encode: Callable[[list[bytes]], dict[bytes, bytes]]) -> None:
        self.encode = encode

    def of(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.__getitem__, words))
        except KeyError:
            if len(self) > CACHE_WORDS:
                self.clear()
            new = self.encode([w for w in dict.fromkeys(words) if w not in self])
            self.update(new)
            out = b"".join(map(self.__getitem__, words))
            for w in new:
                if len(w) > CACHE_WORD_BYTES:
                    del self[w]
            return out
