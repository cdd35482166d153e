"""Chat formatting: layouts found by schema fingerprint, mapped to turns, marked by a template."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame

from logharbor.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
# Characters of formatted text in one output row; a longer conversation takes several.
CHUNK_CHARS = 1 << 18
ROLES = (("human", "user"), ("gpt", "assistant"))


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``each`` is the path of a list of messages, or "" for the record itself, and
    ``turns`` are (role, text paths) of each: a role that starts with "$" is read
    from that path, and several text paths are joined by blank lines. ``optional``
    paths may be missing from a record. ``roles`` renames roles.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    each: str = ""
    optional: frozenset[str] = field(default_factory=frozenset)
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> frozenset[str]:
        used = {p for role, texts in self.turns for p in (*texts, *([role[1:]] if role.startswith("$") else []))}
        return frozenset(f"{self.each}[].{p}" if self.each else p for p in used)

    def fingerprints(self) -> list[str]:
        """Of the paths with and without the optional ones, and of an empty list of messages."""
        every, missing = self.paths(), sorted(self.optional)
        found = [fingerprint(every - set(some)) for n in range(len(missing) + 1) for some in combinations(missing, n)]
        return [*found, fingerprint({f"{self.each}[]"})] if self.each else found


MAPPINGS = (
    Mapping("turn", (("$role", ("text",)),)),
    Mapping("turn content", (("$role", ("content",)),)),
    Mapping("messages", (("$role", ("content",)),), "messages"),
    Mapping("conversations", (("$from", ("value",)),), "conversations", roles=ROLES),
    Mapping("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Mapping("prompt response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Mapping("prompt completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question answer", (("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(value, path: str = "") -> set[str]:
    """Paths of all leaves: ``a.b`` for nested fields, ``a[].b`` for fields of list members."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def apply_mapping(mapping: Mapping, record: dict) -> list[tuple[str, str]]:
    """(role, text) of each turn; a turn whose every path is missing is left out, a null text is empty."""
    def at(value, path):
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return value

    out, names = [], dict(mapping.roles)
    for message in at(record, mapping.each) if mapping.each else [record]:
        for role, paths in mapping.turns:
            there = [p for p in paths if p.split(".")[0] in message]
            if there:
                name = _text(at(message, role[1:])) if role.startswith("$") else role
                texts = [_text(at(message, p)) for p in there]
                out.append((names.get(name, name), texts[0] if len(texts) == 1 else "\n\n".join(t for t in texts if t)))
    return out


def _read_records(mappings: tuple[Mapping, ...], keep: tuple[str, ...]):
    # Only paths that some mapping uses tell layouts apart; ids, names and other fields do not.
    used = {p for m in mappings for p in (*m.paths(), f"{m.each}[]")}

    def rows(batches):
        known = {f: m for m in mappings for f in m.fingerprints()}
        for batch in batches:
            at, subs, roles, texts, prints, raws = [], [], [], [], [], []
            for i, raw in enumerate(batch.column("record").to_pylist()):
                try:
                    record = json.loads(raw or "{}")
                except ValueError:
                    record = None
                mark = fingerprint(field_paths(record) & used) if isinstance(record, dict) else None
                mapping = known.get(mark)
                turns = apply_mapping(mapping, record) if mapping else []
                left = None if turns else raw or ""
                for sub, (role, text) in enumerate(turns or [(None, None)]):
                    for column, value in zip((at, subs, roles, texts, prints, raws), (i, sub, role, text, mark, left), strict=True):
                        column.append(value)
            index = pa.array(at, pa.int64())
            columns = [batch.column(c).take(index) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(subs, pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(prints, pa.string()),
                 pa.array(raws, pa.string())],
                names=[*keep, "sub", "role", "text", "fingerprint", "raw"])

    return rows


def canonical_turns(records: DataFrame, keep: tuple[str, ...], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of records of any known layout: the kept columns, sub, role, text, fingerprint, raw.

    ``record`` is a JSON object. Its fingerprint, a hash of those of its sorted field
    paths that any mapping uses, selects the mapping, whatever other fields there are.
    Records of no known layout, and those without any turn, stay as one row with
    null role and text, their fingerprint (null where the record is no JSON object) and the whole
    record as ``raw`` (null for all others), so nothing is lost. ``sub`` numbers
    the turns of one record. Kept columns may not have the names of the result.
    """
    if {c.lower() for c in keep} & {"sub", "role", "text", "fingerprint", "raw"}:
        raise ValueError("sub, role, text, fingerprint and raw are names of the result")
    small_batches(records.sparkSession)
    kinds = dict(records.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sub int, role string, text string, fingerprint string, raw string"
    return records.select(*keep, "record").mapInArrow(_read_records(mappings, keep), schema)


_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No "<|" is left: each gets a backslash between, as does any that has backslashes there already."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def _format(batches):
    """Rows sorted by conversation and turn -> chunks of formatted text with their loss spans."""
    now, part, pieces, size, spans = None, 0, [], 0, []

    def chunk():
        return now[0], part, "".join(pieces), [a for a, _ in spans], [b for _, b in spans]

    def batch_of(chunks):
        columns = list(zip(*chunks, strict=True))
        kinds = [kind, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["conv_id", "part", "formatted", "loss_from", "loss_to"])

    kind = pa.int64()
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now != (conv,):
                if now is not None:
                    out.append(chunk())
                now, part, pieces, size, spans = (conv,), 0, [], 0, []
            elif size >= CHUNK_CHARS:
                out.append(chunk())
                part, pieces, size, spans = part + 1, [], 0, []
            head, body = f"{START}{escape_role(role or '')}\n", escape(text or "")
            if role == "assistant":
                spans.append((size + len(head), size + len(head) + len(body)))
            pieces.append(f"{head}{body}{END}\n")
            size += len(pieces[-1])
        if out:
            yield batch_of(out)
    if now is not None:
        yield batch_of([chunk()])


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations: conv_id, part, formatted, loss_from, loss_to.

    Turns stand in order of ``turn``, then sub (if there), role and text, nulls
    first; a repeated row is a turn like any other. Null roles and texts are empty.
    Rows with ``raw``, if that column is there, are records that became no turns, and are left out.
    A conversation is the concatenation of its parts in order; spans are code
    points of the part and cover each assistant text alone. A task passes its rows
    on as they come, so a conversation of any length needs the memory of one chunk.
    """
    order = [c for c in ("conv_id", "turn", "sub", "role", "text") if c in turns.columns]
    kind = dict(turns.dtypes)["conv_id"]
    if "raw" in turns.columns:
        turns = turns.where("raw IS NULL")
    return (
        turns.select(*order).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
        .mapInArrow(_format, f"conv_id {kind}, part bigint, formatted string, loss_from array<bigint>, loss_to array<bigint>")
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line, end = formatted.index("\n", at), formatted.index(END, at)
        out.append((unescape_role(formatted[at + len(START):line]), unescape(formatted[line + 1:end])))
        at = end + len(END) + 1
    return out


def _digests(batches):
    state, kind = None, pa.int64()

    def row():
        conv, turns, sums, chars, loss, size = state
        return conv, turns, sums.hexdigest(), chars, loss.hexdigest(), size

    def batch_of(rows):
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for conv, text, begins, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    out.append(row())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(begins, ends, strict=True):
                said = unescape(text[a:b])
                state[3] += len(said)
                state[4].update(said.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        if out:
            yield batch_of(out)
    if state is not None:
        yield batch_of([row()])


def read_back(chunks: DataFrame) -> DataFrame:
    """Counts and digests per conversation, parsed from formatted chunks and their loss spans alone."""
    kind = dict(chunks.dtypes)["conv_id"]
    return (
        chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part")
        .select("conv_id", "formatted", "loss_from", "loss_to")
        .mapInArrow(_digests, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    )
