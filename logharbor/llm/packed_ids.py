"""Token ids packed into rows of one length, best fit decreasing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import small_batches, text_bytes, written
from logharbor.llm.tokenizers import RANKS, WordIds, rank_encoder, read_file

CONTEXT = 2_048
# Ends every document; free in the rank file.
END_ID = 50_256
# Bytes of text that one group packs, about; documents are dealt to groups by hash.
GROUP_BYTES = 8_000_000
# White space that joins a space makes longer pieces than the words' own.
_JOINED = re.compile(r" \s|\s ")


class TextIds:
    """Ids of whole texts as uint16 bytes; each word with the space before it is looked up once."""

    def __init__(self, ranks: bytes) -> None:
        self.encode = rank_encoder(ranks)
        self.words = WordIds(lambda words: {w: self._raw(" " + w) for w in words})

    def _raw(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u2").tobytes()

    def of(self, text: str) -> bytes:
        if _JOINED.search(text):
            return self._raw(text)
        first, *rest = text.split(" ")
        return self._raw(first) + self.words.of(rest)


class Room:
    """Rows by free room, in a segment tree over the possible amounts.

    A leaf says whether any open row has exactly that much room; a node whether
    any leaf below it does. The tightest row that holds n is the first marked
    leaf at n or later, found by one walk up and one down.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with room for ``need``, which leaves the tree; None if there is none."""
        node = need + self.size
        while not self.any[node]:
            while node & 1:
                node >>= 1
            if node <= 1:
                return None
            node += 1
        while node < self.size:
            node *= 2
            if not self.any[node]:
                node += 1
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each row: longest first, each into the open row with the least room that holds it."""
    rows: list[list[int]] = []
    room = Room(capacity)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[item])
        if found is None:
            rows.append([])
            found = capacity, len(rows) - 1
        left, row = found
        rows[row].append(item)
        room.add(left - lengths[item], row)
    return rows


def _pack(ranks: bytes, context: int, end_id: int):
    made: list[TextIds] = []  # one encoder and its known words for all groups of a task

    def group(table: pa.Table) -> pa.Table:
        if not made:
            made.append(TextIds(ranks))
        table = table.sort_by([("doc_id", "ascending"), ("_text", "ascending")])
        ids, group_id = made[0], table.column("_group")[0].as_py()
        docs = table.column("doc_id").to_pylist()
        ends = np.array([end_id], "<u2").tobytes()
        flat = [ids.of(t.decode("utf-8", "replace")) + ends for t in table.column("_text").to_pylist()]
        # Segments (document, first token, tokens); only the last of a document may be shorter than a row.
        segments = [(d, a, min(context, len(x) // 2 - a)) for d, x in enumerate(flat) for a in range(0, len(x) // 2, context)]
        out = []
        for number, row in enumerate(best_fit_decreasing([n for _, _, n in segments], context)):
            parts = [segments[i] for i in row]
            used = sum(n for _, _, n in parts)
            matrix_row = b"".join(flat[d][2 * a:2 * (a + n)] for d, a, n in parts)
            bounds = np.concatenate(([0], np.cumsum([n for _, _, n in parts])))
            out.append((group_id, number, used, matrix_row + ends * (context - used), bounds.tolist(), bounds[:-1].tolist(),
                        [docs[d] for d, _, _ in parts], [a for _, a, _ in parts]))
        columns = list(zip(*out, strict=True))
        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), longs, longs, pa.list_(table.schema.field("doc_id").type), longs]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    return group


NAMES = ["shard", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]


def pack(docs: DataFrame, context: int = CONTEXT, ranks_path: str = RANKS, end_id: int = END_ID, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Packed matrices, one row of ids per row: shard, row, n_tokens, ids, cu_seqlens, position_resets, doc_ids, doc_offsets.

    ``ids`` are ``context`` little-endian uint16 numbers, those past ``n_tokens``
    filled with ``end_id``. Segment i of the row is tokens cu_seqlens[i] to
    cu_seqlens[i + 1], where positions begin again at 0 (position_resets); it holds
    document doc_ids[i] from its token doc_offsets[i] on. Every document ends with
    ``end_id``; one longer than a row fills whole rows and a rest, without loss.

    A shard is one matrix: documents are dealt to shards by a hash of id and text,
    so a shard has about ``group_bytes`` of text at any input size, whatever the
    sources, and is packed by one task. Null and empty texts are the end id alone.
    Repeated rows are packed each; null ids stay null; other columns are not read.
    Empty input gives no rows.
    """
    small_batches(docs.sparkSession)
    ranks = read_file(docs.sparkSession, ranks_path)
    rows = docs.select("doc_id", text_bytes().alias("_text"))
    total = rows.select(F.sum(F.octet_length("_text") + 1).alias("n")).first().n or 0
    groups = max(1, -(-total // group_bytes))
    kind = dict(docs.dtypes)["doc_id"]
    shard = F.pmod(F.xxhash64("doc_id", "_text"), F.lit(groups)).cast("int")
    schema = (f"shard int, row int, n_tokens int, ids binary, cu_seqlens array<bigint>, position_resets array<bigint>, "
              f"doc_ids array<{kind}>, doc_offsets array<bigint>")
    return rows.withColumn("_group", shard).groupBy("_group").applyInArrow(_pack(ranks, context, end_id), schema)


def write_packed(docs: DataFrame, **options) -> DataFrame:
    """The packed matrices written to the shared folder, read from there."""
    return written(pack(docs, **options), "packed")
