"""Growing log files as a stream source.

The offset holds, per path, the bytes consumed up to a line feed, a fingerprint
of the first line and, for local files, the inode, a hash of the block before
the consumed bytes, a count of rotations and the epoch of the last reset. A file
that shrank, was seen empty, begins with another line, is another file under the
same path or holds something else before its consumed bytes was rotated and is read
from byte 0 again; a file that grew goes on behind its former bytes. What a
batch reads follows from two offsets alone, so a restarted query plans the
same ranges. A budget bounds the bytes of a batch. Long ranges are cut into splits
that executors read in parallel.

To compare a file with what was consumed of it, the source must know the last
offset. It remembers it while the query runs; a restarted query finds it in its checkpoint,
if ``checkpoint`` names that folder.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logharbor.runtime import ship_package

ship_package()

TAIL_SCHEMA = "file string, file_ord int, generation string, offset bigint, line string"
SPLIT_BYTES = 64 * 1024 * 1024
READ_BYTES = 4 * 1024 * 1024
OPEN_AT_ONCE = 32
# Bytes before the consumed ones that tell whether a file is still the same.
TAIL_BYTES = 4096

_ARROW = pa.schema([
    ("file", pa.string()), ("file_ord", pa.int32()), ("generation", pa.string()),
    ("offset", pa.int64()), ("line", pa.string()),
])


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _open(path: str) -> pa.NativeFile:
    system, inner = located(path)
    return system.open_input_file(inner)


def _complete_bytes(handle: pa.NativeFile, size: int) -> int:
    """Bytes up to and including the last line feed, searched from the end."""
    end = size
    while end > 0:
        begin = max(0, end - 65536)
        handle.seek(begin)
        at = handle.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def _fingerprint(path: str, handle: pa.NativeFile, complete: int) -> str:
    """Of the first line and, for local files, the inode: neither changes while a file only grows."""
    handle.seek(0)
    head = handle.read(min(complete, 65536)).split(b"\n", 1)[0]
    system, inner = located(path)
    inode = os.stat(inner).st_ino if isinstance(system, pafs.LocalFileSystem) else 0
    return hashlib.md5(b"%d " % inode + head).hexdigest()[:12]


def _before(handle: pa.NativeFile, at: int) -> str:
    """Hash of the block before a position."""
    begin = max(0, at - TAIL_BYTES)
    handle.seek(begin)
    return hashlib.md5(handle.read(at - begin)).hexdigest()[:12]


def _line_end(handle: pa.NativeFile, begin: int, wanted: int, complete: int) -> int:
    """Where whole lines from ``begin`` end, at most at ``wanted`` unless the first one is longer."""
    end = wanted
    while end > begin:
        at = max(begin, end - 65536)
        handle.seek(at)
        found = handle.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    at = wanted
    while at < complete:
        handle.seek(at)
        block = handle.read(min(READ_BYTES, complete - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return complete


def _state(path: str, known: dict | None, epoch: int, share: int | None) -> dict | None:
    """The offset of a file after at most ``share`` more bytes; None if it is absent or has no whole line yet.

    ``known`` is its last offset. With the same file as then, reading goes on there,
    else at byte 0 of a new turn.
    """
    try:
        with _open(path) as handle:
            size = handle.size()
            complete = _complete_bytes(handle, size)
            turn = known["turn"] if known else 0
            if not complete:
                # An emptied file begins anew, whatever its next first line is; one whose first line is not whole yet waits,
                # but is a new one if it holds less than was consumed.
                if size and not (known and known["bytes"] > size):
                    return None
                fresh = bool(known and known["bytes"])
                return {"bytes": 0, "first": "", "tail": "", "turn": turn + fresh, "epoch": epoch}
            first = _fingerprint(path, handle, complete)
            begin = 0
            if known and known["epoch"] == epoch:
                same = known["first"] == first and known["bytes"] <= complete and known["tail"] == _before(handle, known["bytes"])
                begin = known["bytes"] if same else 0
                turn += not same and known["bytes"] > 0
            end = complete if share is None else min(complete, begin + share)
            if end < complete:
                end = _line_end(handle, begin, end, complete)
            return {"bytes": end, "first": first, "tail": _before(handle, end), "turn": turn, "epoch": epoch}
    except (FileNotFoundError, IsADirectoryError):
        return None


def last_offset(checkpoint: str) -> dict:
    """The last offset that a query of this source logged in its checkpoint folder; empty for a new query."""
    system, inner = located(checkpoint)
    found = system.get_file_info(pafs.FileSelector(f"{inner}/offsets", allow_not_found=True))
    numbers = sorted((int(f.base_name), f.path) for f in found if f.base_name.isdigit())
    if not numbers:
        return {}
    with system.open_input_file(numbers[-1][1]) as handle:
        lines = handle.read().decode().splitlines()
    # version, metadata, then one line for each source
    return json.loads(lines[2]) if len(lines) > 2 and lines[2].startswith("{") else {}


@dataclass
class TailSplit(InputPartition):
    path: str
    file_ord: int
    generation: str
    begin: int
    end: int
    first: int      # where the whole new range begins; always a line start
    last: int       # where the whole new range ends; always after a line feed


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths: list[str] = json.loads(options["paths"])
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.max_bytes = int(options["maxBytes"]) if options.get("maxBytes") else None
        self.resets: dict[str, int] = json.loads(options.get("resets", "{}"))
        self.known: dict[str, dict] = last_offset(options["checkpoint"]) if options.get("checkpoint") else {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # Every file gets an equal share of the budget; a line longer than it is read whole.
        share = None if self.max_bytes is None else max(1, self.max_bytes // max(1, len(self.paths)))
        with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
            now = pool.map(lambda p: _state(p, self.known.get(p), int(self.resets.get(p, 0)), share), self.paths)
            for path, state in zip(self.paths, now):
                if state:     # an absent file keeps its last known offset
                    self.known[path] = state
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        splits = []
        for path, new in end.items():
            old = start.get(path)
            marks = ("first", "turn", "epoch")
            grown = old is not None and new["bytes"] > 0 and all(old[k] == new[k] for k in marks) and old["bytes"] <= new["bytes"]
            first = old["bytes"] if grown else 0
            turns = f".{new['turn']}.{new['epoch']}" if new["turn"] or new["epoch"] else ""
            for begin in range(first, new["bytes"], self.split_bytes):
                splits.append(TailSplit(
                    path, self.paths.index(path) if path in self.paths else -1, new["first"] + turns, begin,
                    min(begin + self.split_bytes, new["bytes"]), first, new["bytes"],
                ))
        return splits

    def read(self, partition: TailSplit) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as handle:
            at = _line_start(handle, partition)
            while at < partition.end:
                block = _lines_from(handle, at, partition.last)
                if not block:
                    return
                yield _batch(partition, block, at)
                at += len(block)


def _line_start(handle: pa.NativeFile, split: TailSplit) -> int:
    """First line start in the split; a line belongs to the split it starts in."""
    if split.begin == split.first:
        return split.begin
    at = split.begin - 1
    while at < split.last:
        handle.seek(at)
        block = handle.read(min(READ_BYTES, split.last - at))
        if not block:
            break
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return split.last


def _lines_from(handle: pa.NativeFile, at: int, last: int) -> bytes:
    """A block of whole lines starting at ``at``; longer only for a longer line."""
    handle.seek(at)
    parts = []
    while not parts or b"\n" not in parts[-1]:
        parts.append(handle.read(min(READ_BYTES, last - at)))
        at += len(parts[-1])
        if not parts[-1]:
            return b""      # the file was cut since the range was planned; its lines are gone
    block = b"".join(parts)
    return block[:block.rfind(b"\n") + 1]


def _batch(split: TailSplit, block: bytes, at: int) -> pa.RecordBatch:
    """Lines of a block that start before the split's end.

    Where a split ends is told by line feeds; a bare carriage return also ends a
    line, but what follows it stays with the split.
    """
    raw = np.frombuffer(block, dtype="uint8")
    feed, turn = raw == 10, raw == 13
    paired = turn & np.append(feed[1:], False)          # a carriage return before its line feed
    last = np.flatnonzero(feed | (turn & ~paired))      # last byte of each line
    first = np.append(0, last[:-1] + 1)
    after_feed = np.append(True, feed[last[:-1]])
    beyond = np.flatnonzero((at + first >= split.end) & after_feed)
    n = int(beyond[0]) if len(beyond) else len(first)
    used = int(last[n - 1]) + 1
    text = ~(feed | turn)[:used]
    ends = np.append(0, np.cumsum(text)[last[:n]]).astype("int32")
    body = raw[:used][text].tobytes()
    try:
        block[:used].decode("utf-8")
        lines = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(body))
    except UnicodeDecodeError:      # only a block with bad bytes is decoded line by line
        lines = pa.array([body[a:b].decode("utf-8", errors="ignore") for a, b in zip(ends, ends[1:])], pa.string())
    same = [(split.path, pa.string()), (split.file_ord, pa.int32()), (split.generation, pa.string())]
    return pa.RecordBatch.from_arrays(
        [*(pa.repeat(pa.scalar(value, kind), n) for value, kind in same), pa.array(at + first[:n], pa.int64()), lines],
        schema=_ARROW,
    )


class LogTail(DataSource):
    """``spark.readStream.format("logtail").option("paths", json_list)``."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return TAIL_SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, paths: Sequence[str], split_bytes: int = SPLIT_BYTES, max_bytes: int | None = None,
               checkpoint: str | None = None, resets: dict[str, int] | None = None) -> DataFrame:
    """New whole lines of the files as a stream, with their byte offsets.

    ``max_bytes`` bounds what one batch reads; the rest follows in later batches
    (``live.run_to_table(..., catch_up=True)`` runs until none is left). ``checkpoint`` is the
    query's checkpoint folder, from which a restarted query learns what it had read;
    a budget needs it. ``resets`` maps paths to epochs: a path whose epoch
    differs from that of its last offset is read from its start again, the
    others go on. A run with a fresh checkpoint folder reads everything again.
    """
    names = [p.strip() for p in paths if p and p.strip()]
    if not names:
        raise ValueError("no log files given")
    if max_bytes is not None and not checkpoint:
        raise ValueError("a byte budget needs the query's checkpoint folder")
    spark.dataSource.register(LogTail)
    options = {"paths": json.dumps(names), "splitBytes": str(split_bytes), "resets": json.dumps(resets or {})}
    if max_bytes is not None:
        options["maxBytes"] = str(int(max_bytes))
    if checkpoint:
        options["checkpoint"] = checkpoint
    return spark.readStream.format("logtail").options(**options).load()
