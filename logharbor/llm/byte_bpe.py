"""Byte-level BPE: text to ids of a rank file and back.

Pieces are found without regular expressions. Every code point has a class, and a
class is a function from the state before it to the state after it. Those functions
are closed under composition and few, so they are numbered, and a scan over their
numbers by an associative table gives the state before every character at once. A
piece begins where the state and the class say so. The pieces' bytes are merged by
rank, each different piece once as long as it is remembered.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import small_batches
from logharbor.llm.tokenizers import CACHE_WORD_BYTES, CACHE_WORDS, RANKS, read_file

# Characters whose pieces are sought at once; longer texts are read in such blocks.
BLOCK_CHARS = 1 << 18
# Characters in a row of the scan; rows are scanned side by side.
ROW_CHARS = 256
# From this many bytes on, a piece is merged alone with a heap; shorter ones are merged side by side.
HEAP_BYTES = 64
NO_PAIR = 1 << 40

# White_Space of Unicode.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Letters and numbers that Unicode 16 added and unicodedata of Python 3.13 does not know.
ADDED = {
    "L": ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
          (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
          (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
          (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)),
    "N": ((0x10D40, 0x10D65), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
          (0x1E5F1, 0x1E5FA)),
}

# Classes of characters. LETTER_1 ends a contraction of one letter ('s 't 'm 'd); LETTER_2 begins one of two ('re 've 'll),
# which the next character decides, as it does whether white space is followed by other text.
LETTER, LETTER_1, LETTER_2, NUMBER, OTHER, QUOTE, SPACE, SPACE_LAST, WHITE_LAST, END = range(10)
# States: what the character before belongs to. IN_QUOTE: a quote that may begin a contraction; IN_PAIR: the first of its two letters.
IN_LETTERS, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_SPACE, AFTER_WHITE, IN_QUOTE, IN_PAIR, AFTER_CONTRACTION, AT_START = range(10)


def _next_state(state: int, kind: int) -> int:
    if kind in (LETTER, LETTER_1, LETTER_2):
        if state == IN_PAIR or state == IN_QUOTE and kind == LETTER_1:
            return AFTER_CONTRACTION
        return IN_PAIR if state == IN_QUOTE and kind == LETTER_2 else IN_LETTERS
    if kind == QUOTE:
        return IN_OTHER if state in (IN_OTHER, IN_QUOTE, AFTER_SPACE) else IN_QUOTE
    return {NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: IN_SPACE, SPACE_LAST: AFTER_SPACE, WHITE_LAST: AFTER_WHITE, END: AT_START}[kind]


def _begins(state: int, kind: int) -> bool:
    """Whether a piece begins with a character of this class after this state."""
    after = _next_state(state, kind)
    if kind == END or state in (AT_START, AFTER_WHITE, AFTER_CONTRACTION):
        return True
    if state == AFTER_SPACE:
        return False
    if state == IN_QUOTE:
        return after not in (IN_PAIR, AFTER_CONTRACTION, IN_OTHER)
    if state == IN_PAIR:
        return False
    return {IN_LETTERS: IN_LETTERS, IN_NUMBER: IN_NUMBER, IN_OTHER: IN_OTHER, IN_SPACE: IN_SPACE}[state] != after


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the classes' functions, the table that composes two, the state each gives from AT_START, the beginnings."""
    states = range(10)
    basic = [tuple(_next_state(s, k) for s in states) for k in range(10)]
    known = {tuple(states): 0}
    todo = [tuple(states)]
    while todo:
        f = todo.pop()
        for g in basic:
            both = tuple(g[f[s]] for s in states)
            if both not in known:
                known[both] = len(known)
                todo.append(both)
    functions = list(known)
    compose = np.array([[known[tuple(g[f[s]] for s in states)] for g in functions] for f in functions], np.uint8)
    begins = np.array([[_begins(s, k) for k in range(10)] for s in states])
    return np.array([known[f] for f in basic], np.uint8), compose.ravel(), np.array([f[AT_START] for f in functions], np.uint8), begins.ravel()


OF_CLASS, COMPOSE, STATE_AFTER, BEGINS = _closure()
FUNCTIONS = len(STATE_AFTER)


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Runs of code points of one class: lengths and classes, in order of the code points."""
    kinds = np.fromiter(
        ({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        for a, b in ADDED[name]:
            kinds[a:b + 1] = kind
    kinds[list(WHITE_SPACE)] = WHITE_LAST
    kinds[ord(" ")], kinds[ord("'")] = SPACE_LAST, QUOTE
    kinds[[ord(c) for c in "stmd"]] = LETTER_1
    at = np.flatnonzero(np.diff(kinds, prepend=255))
    return np.diff(np.append(at, len(kinds))), kinds[at]


def scan(functions: np.ndarray) -> np.ndarray:
    """Numbers of the compositions of all functions before each, by rows side by side, then by the rows' own compositions."""
    n = len(functions)
    if n <= ROW_CHARS:
        rows = functions[None, :]
    else:
        rows = np.zeros(-(-n // ROW_CHARS) * ROW_CHARS, np.uint8)
        rows[:n] = functions
        rows = rows.reshape(-1, ROW_CHARS)
    columns = np.ascontiguousarray(rows.T)
    before = np.zeros_like(columns)
    now = np.zeros(columns.shape[1], np.uint8)
    for i in range(len(columns)):
        before[i] = now
        now = COMPOSE[now.astype(np.intp) * FUNCTIONS + columns[i]]
    if columns.shape[1] > 1:
        before = COMPOSE[scan(now).astype(np.intp)[None, :] * FUNCTIONS + before]
    return before.T.ravel()[:n]


class Splitter:
    """Where pieces begin in a run of characters."""

    def __init__(self, lengths: np.ndarray, kinds: np.ndarray) -> None:
        self.kinds = np.repeat(kinds, lengths)

    def classes(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Class of each code point but the last, which is only looked at; ``ends`` are places between texts."""
        kinds = self.kinds[points]
        kinds[ends] = END
        now, after = kinds[:-1], kinds[1:]
        white = (now == SPACE_LAST) | (now == WHITE_LAST)
        next_white = (after == SPACE_LAST) | (after == WHITE_LAST) | (after == END)
        out = np.where(white & next_white, np.uint8(SPACE), now)
        e, l = points[1:] == ord("e"), points[1:] == ord("l")
        first = points[:-1]
        out[(((first == ord("r")) | (first == ord("v"))) & e) | ((first == ord("l")) & l)] = LETTER_2
        return out

    def begins(self, points: np.ndarray, ends: np.ndarray, carry: int) -> tuple[np.ndarray, int]:
        """Whether a piece begins at each code point but the last, and the function of all read so far; ``carry`` is that before."""
        kinds = self.classes(points, ends)
        before = scan(np.concatenate((np.array([carry], np.uint8), OF_CLASS[kinds])))
        states = STATE_AFTER[before[1:]].astype(np.intp)
        last = int(COMPOSE[int(before[-1]) * FUNCTIONS + int(OF_CLASS[kinds[-1]])]) if len(kinds) else carry
        return BEGINS[states * 10 + kinds], last


def _utf8_bytes(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


class Pairs:
    """Which neighbours may be merged: pairs of ids as sorted numbers, and the id (its rank) of what they make."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {}
        for token, number in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = number
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], NO_PAIR)


def merge_all(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids (uint32 bytes) of short pieces, side by side: in each the neighbours of least rank are merged, the leftmost of equals.

    A round makes one merge in every piece that still has one; the others leave.
    """
    out: list[bytes] = [b""] * len(pieces)
    if not pieces or not len(pairs.keys):
        return [pairs.bytes[np.frombuffer(p, np.uint8)].astype("<u4").tobytes() for p in pieces]
    ids = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    sizes = np.array([len(p) for p in pieces])
    names = np.arange(len(pieces))
    ends = np.cumsum(sizes)
    ranks = np.append(pairs.look_up(ids[:-1], ids[1:]), NO_PAIR)
    ranks[ends - 1] = NO_PAIR
    while True:
        starts = ends - sizes
        least = np.minimum.reduceat(ranks, starts)
        done = least == NO_PAIR
        if done.any():
            flat = ids.astype("<u4").tobytes()
            for name, a, b in zip(names[done].tolist(), (4 * starts[done]).tolist(), (4 * ends[done]).tolist(), strict=True):
                out[name] = flat[a:b]
            if done.all():
                return out
            stay = np.repeat(~done, sizes)
            ids, ranks, names, sizes, least = ids[stay], ranks[stay], names[~done], sizes[~done], least[~done]
            ends = np.cumsum(sizes)
            starts = ends - sizes
        hit = np.flatnonzero(ranks == np.repeat(least, sizes))
        owner = np.searchsorted(ends, hit, "right")
        at = hit[np.diff(owner, prepend=-1) != 0]
        # at: the left of the merged pair in each piece; its right neighbour goes.
        ids[at] = least
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        at -= np.arange(len(at))
        ids, ranks, sizes = ids[stay], ranks[stay], sizes - 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        right = at + 1 < ends
        ranks[at] = NO_PAIR
        ranks[at[right]] = pairs.look_up(ids[at[right]], ids[at[right] + 1])
        left = at > starts
        ranks[at[left] - 1] = pairs.look_up(ids[at[left] - 1], ids[at[left]])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece of any length, by a heap of its neighbours."""
    n = len(piece)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    live = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        # A pair is stale when either side has been merged since.
        if not live[i] or middle >= n or not live[middle] or end[middle] != stop:
            continue
        live[middle], end[i] = 0, stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        before = back[i]
        if before >= 0 and (r := ranks.get(piece[before:stop])) is not None:
            heapq.heappush(heap, (r, before, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ids of texts; pieces that were merged already are remembered."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs, runs: tuple[np.ndarray, np.ndarray]) -> None:
        self.ranks, self.pairs, self.known = ranks, pairs, {}
        self.splitter = Splitter(*runs)
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.widths[number] = len(token)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Remember the ids of all these pieces; returns the ones too long to be kept for long."""
        new = [p for p in set(pieces).difference(self.known) if p]
        short = []
        for piece in new:
            number = self.ranks.get(piece)
            if number is not None:
                self.known[piece] = number.to_bytes(4, "little")
            elif len(piece) >= HEAP_BYTES:
                self.known[piece] = np.array(_merge_long(piece, self.ranks), "<u4").tobytes()
            else:
                short.append(piece)
        self.known.update(zip(short, merge_all(short, self.pairs), strict=True))
        return [p for p in new if len(p) > CACHE_WORD_BYTES]

    def _blocks(self, texts: list[str]):
        """Parts (text, its characters, whether it ends there) read at once, and the character that follows."""
        held, size = [], 0
        for i, text in enumerate(texts):
            at = 0
            while True:
                part = text[at:at + BLOCK_CHARS]
                at += len(part)
                held.append((i, part, at >= len(text)))
                size += len(part) + 1
                if size >= BLOCK_CHARS:
                    yield held, text[at:at + 1]
                    held, size = [], 0
                if at >= len(text):
                    break
        if held:
            yield held, ""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A mark stands after each text, and is a piece of its own that gives no ids."""
        out: list[list[bytes]] = [[] for _ in texts]
        carry, rest = int(OF_CLASS[END]), b""
        for held, ahead in self._blocks(texts):
            flat, marks, size = [], [], 0
            for _, part, last in held:
                flat.append(part)
                size += len(part)
                if last:
                    flat.append("\n")
                    marks.append(size)
                    size += 1
            joined = "".join(flat)
            points = np.frombuffer((joined + (ahead or "\n")).encode("utf-32-le"), np.uint32)
            begins, carry = self.splitter.begins(points, np.array(marks if ahead else [*marks, size], np.int64), carry)
            begins[0] |= not rest
            data = rest + joined.encode()
            byte_at = np.cumsum(_utf8_bytes(points[:-1]))
            places = np.flatnonzero(begins)
            # Bytes from ``data``'s begin to each place; what an earlier block left comes before its first piece.
            cuts = byte_at[places] - _utf8_bytes(points[places]) + len(rest)
            if rest:
                cuts = np.concatenate(([0], cuts))
            after_mark = np.searchsorted(cuts, byte_at[marks] + len(rest) - 1) if marks else np.zeros(0, np.int64)
            stops = [*cuts[1:].tolist(), len(data)]
            pieces = [data[a:b] for a, b in zip(cuts.tolist(), stops, strict=True)]
            rest = b""
            if not held[-1][2]:  # the last piece goes on in the next block
                rest = pieces.pop()
            for at in after_mark.tolist():
                pieces[at] = b""
            long = self._learn(pieces)
            known, first = self.known, 0
            known[b""] = b""
            owners = [i for i, _, last in held if last]
            for i, at in zip(owners, after_mark.tolist(), strict=True):
                out[i].append(b"".join(map(known.__getitem__, pieces[first:at])))
                first = at + 1
            if first < len(pieces):
                out[held[-1][0]].append(b"".join(map(known.__getitem__, pieces[first:])))
            for piece in long:
                del known[piece]
            if len(known) > CACHE_WORDS:
                known.clear()
        return [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in out]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte of the text at which each token ends."""
        return np.cumsum(self.widths[ids])


def _read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def _encode(raw: bytes, pairs: Pairs, runs: tuple[np.ndarray, np.ndarray], keep: list[str], text: str):
    def rows(batches):
        encoder = Encoder(_read_ranks(raw), pairs, runs)
        for batch in batches:
            ids = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            ends = [encoder.ends(x) for x in ids]
            bounds = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            stops = pa.array(np.concatenate([np.zeros(0, np.int64), *ends]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(bounds, flat), pa.ListArray.from_arrays(bounds, stops)],
                names=[*keep, "ids", "ends"])

    return rows


def encode_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """The kept columns, ``ids`` and ``ends`` of every row's whole text.

    ``ids`` are those of the rank file, pieces encoded one by one, without special
    tokens; token i holds the bytes of the text from ends[i - 1] to ends[i]. Null
    and empty texts have empty arrays; repeated rows are encoded each; columns that
    are not kept are not read, and kept ones named ``ids`` or ``ends`` are refused;
    an empty table gives an empty result. Texts are read in blocks, so that memory
    beyond the text and its ids is that of a block.
    """
    if {"ids", "ends"} & {c.lower() for c in keep}:
        raise ValueError("ids and ends are names of the result")
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "ids array<int>, ends array<bigint>"
    name = "_".join(["_text", *keep])  # a name that no kept column has
    rows = docs.select(*keep, F.col(text).cast("string").alias(name))
    raw = read_file(docs.sparkSession, ranks_path)
    return rows.mapInArrow(_encode(raw, Pairs(_read_ranks(raw)), class_runs(), list(keep), name), schema)


def _decode(raw: bytes):
    def rows(batches):
        tokens = {number: token for token, number in _read_ranks(raw).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rows


def decode_ids(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """All columns and ``decoded``, the bytes of the row's ``ids``; null ids give null, unknown ids an error."""
    small_batches(encoded.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded binary"
    return encoded.mapInArrow(_decode(read_file(encoded.sparkSession, ranks_path)), schema)


def round_trip_digests(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    encoded = encode_texts(docs, ("doc_id",), "text", ranks_path).select("doc_id", "ids")
    decoded = decode_ids(encoded, ranks_path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
