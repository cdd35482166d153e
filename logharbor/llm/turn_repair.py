"""Repair of conversation structure by alignment to an alternating target.

A conversation should read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. Its turns are aligned (Wagner-Fischer) to target strings of
each feasible length; Ukkonen's bands leave out cells that no alignment cheaper
than the best one so far can pass; of equally cheap ones the least audit wins.

A long conversation is aligned block by block. What a block must know of its
neighbours is only what was last written, one of four states, so a block's
result is its cheapest audit from each state to each. Results of neighbouring
blocks are joined in rounds, a bounded number at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import small_batches, written

# Costs of the edits, by their initials in the audit; an undeleted truncated turn costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Turns of one block, at most 2 to this power; blocks joined in one step.
BLOCK_BITS = 5
JOINED_BLOCKS = 16
# Different runs of turns whose audits a task remembers at once.
KNOWN_RUNS = 50_000
# What was written last: nothing, the system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# Initials and faults of turns; a turn's code is one letter for both.
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
_FIRST_CODE = ord("A")
_LEGAL = {"su", "ua", "au"}


def code_of(initial: str, fault: str) -> str:
    """The letter of a turn; an initial other than s, u, a is as good as any other."""
    return chr(_FIRST_CODE + 4 * FAULTS.index(fault) + (INITIALS.index(initial) if initial in tuple("sua") else 3))


def _meaning(code: str) -> tuple[str, str]:
    fault, initial = divmod(ord(code) - _FIRST_CODE, 4)
    return INITIALS[initial], FAULTS[fault]


def _shift_cost(diagonal: int) -> int:
    """Least cost of moving by so many diagonals: inserts to the right, deletions to the left."""
    return INSERT * diagonal if diagonal > 0 else -DELETE * diagonal


def align(codes: str, target: str, best: int) -> tuple[int, str] | None:
    """Cheapest (cost, audit) that turns the coded turns into ``target``; None if it costs more than ``best``.

    Cell (i, j): the first i turns were read, the first j letters written. A cell on
    diagonal d = j - i is passed only if the moves to d and from d to the last
    diagonal cost at most ``best``: the band around both. The table is filled from
    the end, so the walk from the start can take the least letter among equals.
    """
    n, m = len(codes), len(target)
    last = m - n
    low, high = min(0, last), max(0, last)
    while _shift_cost(low - 1) + _shift_cost(last - low + 1) <= best:
        low -= 1
    while _shift_cost(high + 1) + _shift_cost(last - high - 1) <= best:
        high += 1
    turns = [_meaning(c) for c in codes]
    far = best + 1
    width = high - low + 1

    def match(i: int, j: int) -> int:
        """Cost of letting turn i stand as letter j, by keeping or by another role."""
        initial, fault = turns[i]
        if fault in ("blank", "duplicate"):
            return far
        cost = TRUNCATED if fault == "truncated" else 0
        if initial == target[j]:
            return cost + KEEP
        return far if target[j] == "s" else cost + REROLE

    # rest[i][d - low]: cost of all that follows cell (i, i + d).
    rest = [[far] * width for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = rest[i], rest[i + 1] if i < n else None
        for d in range(high, low - 1, -1):
            j = i + d
            if not 0 <= j <= m:
                continue
            if i == n and j == m:
                row[d - low] = 0
                continue
            cost = far
            if below is not None:
                if d > low:
                    cost = DELETE + below[d - 1 - low]
                if j < m:
                    cost = min(cost, match(i, j) + below[d - low])
            if j < m and target[j] != "s" and d < high:
                cost = min(cost, INSERT + row[d + 1 - low])
            row[d - low] = min(cost, far)
    total = rest[0][-low]
    if total > best:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):
        d, here = j - i, rest[i][j - i - low]
        if i < n and d > low and DELETE + rest[i + 1][d - 1 - low] == here:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and d < high and INSERT + rest[i][d + 1 - low] == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def _after(state: int, length: int, system: bool) -> tuple[str, int]:
    """The next ``length`` letters after ``state``, and the state after them."""
    if not length:
        return "", state
    out = "s" if system else ""
    pair = "au" if state == USER else "ua"
    out += (pair * length)[: length - len(out)]
    return out, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[out[-1]]


def align_block(codes: str, first: bool = False) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a run of turns: the cheapest and of these the least audit.

    Lengths are tried from the number of turns outwards, as long as a length alone
    does not cost more than the best found for both states that it can end in. The
    first block of a conversation begins with nothing written.
    """
    n, out = len(codes), []
    for before in (NOTHING,) if first else (NOTHING, SYSTEM, USER, ASSISTANT):
        # Deleting all turns writes nothing; a system turn alone is one of the turns.
        best: dict[int, tuple[int, str]] = {before: (DELETE * n, "D" * n)}
        if before == NOTHING and (found := align(codes, "s", DELETE * n)):
            best[SYSTEM] = found
        for step in range(2 * n + 4):
            length = n + (step + 1) // 2 * (1 if step % 2 else -1)
            limit = max(best[e][0] if e in best else DELETE * n + INSERT * 2 for e in (USER, ASSISTANT))
            if length < 1 or _shift_cost(length - n) > limit:
                continue
            for system in (False, True) if before == NOTHING and length > 1 else (False,):
                target, after = _after(before, length, system)
                held = best.get(after)
                found = align(codes, target, held[0] if held else DELETE * n + INSERT * length)
                if found and (held is None or found < held):
                    best[after] = found
        out += [(before, after, *found) for after, found in sorted(best.items())]
    return out


def join_blocks(blocks: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """Neighbouring runs of turns as one run; the least audit among the cheapest of each pair of states.

    Audits of a run with the same states and cost never continue one another (a
    longer one would hold more inserts and cost more), so the least of the whole
    is made of the least of each run.
    """
    now = blocks[0]
    for after in blocks[1:]:
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for a, b, cost, audit in now:
            for c, d, cost2, audit2 in after:
                if b == c:
                    whole = cost + cost2, audit + audit2
                    if (a, d) not in best or whole < best[a, d]:
                        best[a, d] = whole
        now = [(*k, *v) for k, v in sorted(best.items())]
    return now


class Replay:
    """Applies an audit to turns that come one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last = audit, 0, ""

    def _place(self, role: str | None, text: str) -> tuple[str, str]:
        if role is None:
            role = "assistant" if self.last == "u" else "user"
        self.last = role[:1]
        return role, text

    def inserts(self):
        """Empty turns that stand before the next turn, or at the end."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._place(None, "")

    def feed(self, turns):
        for role, text in turns:
            yield from self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                yield self._place(role, text)
            elif edit == "R":
                yield self._place(None, text)


# Fixed value: what counts as space at a text's end.
_SPACES = " \t\n\x0b\x0c\r"
_ORDER = ["conv_id", "turn", "_role", "_text", "_copy"]


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, _role, _text, _copy of the turns that the damage leaves.

    The crc32 of ``conv_id:turn`` (a null is one space) modulo 20 drops a turn (0),
    empties its text (1), takes all of ``.!?`` from it (2), repeats it (3) or makes
    its role user (4). Null roles and texts are one space.
    """
    way = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("_role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("_text"), way.alias("_way"))
    return rows.where("_way <> 0").select(
        "conv_id", "turn", F.expr("IF(_way = 4, 'user', _role) AS _role"),
        F.expr("CASE _way WHEN 1 THEN '' WHEN 2 THEN translate(_text, '.!?', '') ELSE _text END AS _text"),
        F.explode(F.expr("IF(_way = 3, array(0, 1), array(0))")).alias("_copy"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Turns written in order, with ``pos``, their place among all.

    Ranges are cut by the order itself, so one conversation may fill many tasks. A
    range's first place is a running sum over the counts of the ranges before it.
    """
    head = F.substring("_text", 1, 32)
    placed = turns.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("_role"), head).sortWithinPartitions(*_ORDER)
    rows = written(placed.withColumn("_at", F.monotonically_increasing_id()), "turns").withColumn("_range", F.shiftright("_at", 33))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n") - F.shiftleft("_range", 33)
    return rows.join(F.broadcast(ranges.select("_range", before.alias("_move"))), "_range").select(
        "conv_id", "turn", "_role", "_text", (F.col("_at") + F.col("_move")).alias("pos"))


def coded_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, turn, code: each turn's initial and first fault as one letter, no texts."""
    key = F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text").cast("binary"), 256)
    first = turns.groupBy("conv_id", key.alias("_key")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    end = F.substring(F.rtrim("_text", F.lit(_SPACES)), -1, 1)
    narrow = turns.select("conv_id", "pos", "turn", F.substring("_role", 1, 1).alias("_initial"), end.alias("_end"))
    fault = F.expr("CASE WHEN _end = '' THEN 4 WHEN _first IS NULL THEN 8 WHEN _end NOT IN ('.', '!', '?') THEN 12 ELSE 0 END")
    initial = F.expr("CASE _initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    return narrow.join(first, "pos", "left").select("conv_id", "pos", "turn", F.char(F.lit(_FIRST_CODE) + fault + initial).alias("code"))


_STATES = "array<struct<before: int, after: int, cost: bigint, audit: string>>"
_RUN = f"begins string, ends string, illegal bigint, runs {_STATES}"


def _illegal(codes: str) -> int:
    initials = [_meaning(c)[0] for c in codes]
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _runs_array(runs: list) -> pa.Array:
    names = ("before", "after", "cost", "audit")
    kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.array([[dict(zip(names, r, strict=True)) for r in run] for run in runs], kind)


def _batch(batch: pa.RecordBatch, keep: list[str], rows: list) -> pa.RecordBatch:
    begins, ends, illegal, runs = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in keep), pa.array(begins, pa.string()), pa.array(ends, pa.string()), pa.array(illegal, pa.int64()), _runs_array(runs)],
        names=[*keep, "begins", "ends", "illegal", "runs"])


def _align_blocks(batches):
    known: dict[tuple[str, bool], tuple] = {}  # short runs of turns are often alike
    for batch in batches:
        rows = []
        for key in zip(batch.column("codes").to_pylist(), batch.column("first").to_pylist(), strict=True):
            if key not in known:
                if len(known) >= KNOWN_RUNS:
                    known.clear()
                codes, first = key
                known[key] = codes[0], codes[-1], _illegal(codes), align_block(codes, bool(first))
            rows.append(known[key])
        yield _batch(batch, ["conv_id", "block"], rows)


def _join_runs(batches):
    for batch in batches:
        rows = []
        for blocks in batch.column("blocks").to_pylist():
            between = sum(_illegal(a["ends"] + b["begins"]) for a, b in zip(blocks, blocks[1:], strict=False))
            runs = join_blocks([[(r["before"], r["after"], r["cost"], r["audit"]) for r in b["runs"]] for b in blocks])
            rows.append((blocks[0]["begins"], blocks[-1]["ends"], between + sum(b["illegal"] for b in blocks), runs))
        yield _batch(batch, ["conv_id", "block"], rows)


def aligned(coded: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit of each conversation among coded turns."""
    kind = dict(coded.dtypes)["conv_id"]
    block = F.shiftright("pos", BLOCK_BITS)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"]), "")
    blocks = written(coded.groupBy("conv_id", block.alias("block")).agg(codes.alias("codes")), "blocks")
    begins = blocks.groupBy("conv_id").agg(F.min("block").alias("block")).select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.lit(True).alias("first"))
    found = blocks.join(begins, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    runs = written(found.select("conv_id", "block", "codes", "first")
                   .mapInArrow(_align_blocks, f"conv_id {kind}, block bigint, {_RUN}"), "runs")
    # Rounds: neighbouring blocks are joined, JOINED_BLOCKS at most, until every conversation has one.
    while (runs.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        joined = (
            runs.groupBy("conv_id", F.floor(F.col("block") / JOINED_BLOCKS).alias("_to"))
            .agg(F.array_sort(F.collect_list(F.struct("block", "begins", "ends", "illegal", "runs"))).alias("blocks"))
            .select("conv_id", F.col("_to").alias("block"), "blocks")
        )
        runs = written(joined.mapInArrow(_join_runs, f"conv_id {kind}, block bigint, {_RUN}"), "runs")
    # From nothing written to nothing or an assistant turn.
    ends = F.filter("runs", lambda r: (r["before"] == NOTHING) & r["after"].isin(NOTHING, ASSISTANT))
    least = F.array_min(F.transform(ends, lambda r: F.struct(r["cost"].alias("cost"), r["audit"].alias("audit"))))
    return runs.select("conv_id", "illegal", least.alias("_least")).select("conv_id", "illegal", "_least.cost", "_least.audit")


def _digests(batches):
    """Rows by conversation, its header first, then its turns by pos -> counts and digest of the repaired turns."""
    kept = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    state = None

    def add(said):
        for role, text in said:
            state[1].update(f"{state[3]}{role}:{text}".encode())
            state[3] = "\n"

    def close():
        add(state[2].inserts())
        return state[0], state[1].hexdigest()

    def batch_of(schema, rows):
        names = [*kept, "repaired_sha256"]
        kinds = [*(schema.field(c).type for c in kept), pa.string()]
        columns = zip(*((*head, digest) for head, digest in rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = None
    for batch in batches:
        schema, out = batch.schema, []
        rows = zip(*(batch.column(c).to_pylist() for c in (*kept, "pos", "_role", "_text")), strict=True)
        for *head, pos, role, text in rows:
            if pos is None:
                if state is not None:
                    out.append(close())
                state = [head, hashlib.sha256(), Replay(head[-1]), ""]
            else:
                add(state[2].feed([(role, text)]))
        if out:
            yield batch_of(schema, out)
    if state is not None:
        yield batch_of(schema, [close()])


def repair_turns(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``turns`` (conv_id, turn, _role, _text, _copy) are the turns to be repaired, in
    order of turn (nulls first), then role and text; ``conversations`` names all that
    get a row. A turn's first fault counts: blank, duplicate (role and text seen
    earlier), truncated. Edits and costs are the constants above.

    A role without any initial fits no place as it is. Null ids are one conversation of their own. One without turns has zeros, an empty
    audit and the digest of an empty text. gaps beyond a long are the greatest long. Repeated rows
    are duplicates; other columns are not read; an empty table gives an empty result.
    Texts of any length are whole. No task holds a conversation: turns are numbered
    in ranges, aligned in blocks of 2**BLOCK_BITS, and pass one by one where the
    digest is taken, which by its nature reads a conversation in order; memory there
    is the audit, one letter a turn.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    turns = numbered_turns(turns)
    coded = written(coded_turns(turns), "codes")
    faults = F.floor((F.ascii("code") - _FIRST_CODE) / 4)
    counts = coded.groupBy("conv_id").agg(*(F.count_if(faults == i).alias(FAULTS[i]) for i in (1, 2, 3)))
    each = coded.where("turn IS NOT NULL").select("conv_id", F.col("turn").cast("decimal(38,0)").alias("turn")).distinct()
    most = "9223372036854775807BD"
    gaps = each.groupBy("conv_id").agg(F.expr(f"CAST(least({most}, max(turn) - min(turn) + 1 - count(*)) AS bigint) AS gaps"))
    rows = conversations.select("conv_id")
    for part in (counts, gaps, aligned(coded)):
        rows = rows.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    heads = rows.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers),
                                        F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    both = heads.unionByName(turns.select("conv_id", "pos", "_role", "_text"), allowMissingColumns=True)
    kind = dict(heads.dtypes)["conv_id"]
    schema = (f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
              "audit string, repaired_sha256 string")
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("pos")).mapInArrow(_digests, schema)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """``repair_turns`` of the turns that ``damaged_turns`` leaves."""
    return repair_turns(conversations, damaged_turns(conversations))
