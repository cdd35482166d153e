"""Turn repair, byte-level BPE and whitening against plain versions on small tables."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from logharbor.llm import byte_bpe, turn_repair, whitening
from logharbor.llm.tokenizers import RANKS, SPLIT

SPACES = " \t\n\x0b\x0c\r"


# ---- conversations ----

def all_repairs(turns, inserts=1):
    """(cost, audit, result) of every edit script with few inserts whose result is legal; turns are (role, text, fault)."""
    import re

    legal, out = re.compile(r"(s?(ua)+)?"), []

    def go(i, left, cost, audit, done):
        if i == len(turns):
            if legal.fullmatch("".join(r[:1] or "?" for r, _ in done)):
                out.append((cost, audit, done))
        else:
            role, text, fault = turns[i]
            go(i + 1, left, cost + 2, audit + "D", done)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(i + 1, left, cost + more, audit + "K", [*done, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, left, cost + 1 + more, audit + "R", [*done, (r, text)])
        if left:
            for r in ("user", "assistant"):
                go(i, left - 1, cost + 5, audit + "I", [*done, (r, "")])

    go(0, inserts, 0, "", [])
    return out


def plain_repair(rows):
    """Damage and repair of one conversation's (conv_id, turn, role, text) rows, by trying every script."""
    after = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if way == 1 else text.translate({ord(c): None for c in ".!?"}) if way == 2 else text
        after += [] if way == 0 else [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in after:
        end = text.rstrip(SPACES)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault))
    numbers = [t for t, _, _ in after if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults = [f for _, _, f in turns]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, done = min(all_repairs(turns))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def conversations(seed, n):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.randint(1, 4)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"])
            text = draw.choice(["one.", "two!", "three", "", " \t", None, f"text {draw.random()}?", "é. \n", "x." + " " * 50])
            rows.append((conv, draw.choice([turn, turn, turn, 7 * turn, None]), role, text))
    return rows


@pytest.mark.parametrize(("bits", "joined"), [(1, 2), (5, 16)])
def test_turn_repair(spark, monkeypatch, bits, joined):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(turn_repair, "JOINED_BLOCKS", joined)
    rows = conversations(bits, 40)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string").repartition(5)
    got = turn_repair.damaged_and_repaired(frame).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert len(got) == len(groups)
    for r in got:
        want = plain_repair(groups[r.conv_id])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want


def test_long_conversation_and_empty(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert turn_repair.damaged_and_repaired(frame).count() == 0
    draw = random.Random(5)
    roles = [draw.choice(["user", "assistant", "system"]) for _ in range(700)]
    rows = [(1, i, r, f"{i}{draw.choice(['.', ''])}") for i, r in enumerate(roles)] + [(2, -(1 << 62) * 2, "user", "a."), (2, (1 << 63) - 1, "assistant", "b.")]
    got = {r.conv_id: r for r in turn_repair.damaged_and_repaired(spark.createDataFrame(rows, frame.schema).repartition(7)).collect()}
    # The same grammar as an automaton over the turns, without lengths or blocks.
    kept = [(i, r, t) for _, i, r, t in rows[:700] for w in [zlib.crc32(f"1:{i}".encode()) % 20] if w for _ in range(2 if w == 3 else 1)]
    best, seen = {"": (0, "")}, set()
    for i, role, text in kept:
        way = zlib.crc32(f"1:{i}".encode()) % 20
        role, text = "user" if way == 4 else role, "" if way == 1 else text.replace(".", "") if way == 2 else text
        must, more = not text or (role, text) in seen, 0 if text.endswith(".") else 5
        seen.add((role, text))
        after = {}
        for last, (cost, audit) in best.items():
            steps = [(last, cost + 2, "D")]
            if not must:
                steps += [("s", cost + more, "K")] * (not last and role == "system")
                to = "a" if last == "u" else "u"
                steps.append((to, cost + more + (role[0] != to), "K" if role[0] == to else "R"))
            for to, c, e in steps:
                after[to] = min(after.get(to, (1 << 40, "")), (c, audit + e))
        best = after
    want = min(best[x] for x in ("", "a") if x in best)
    assert (got[1].cost, got[1].audit) == want
    assert got[2].gaps == (1 << 63) - 1 or len(got[2].audit) < 2


def test_blocks_join_to_the_whole():
    draw = random.Random(6)
    codes = [turn_repair.code_of(i, f) for i in "sua?" for f in turn_repair.FAULTS]
    for _ in range(60):
        text = "".join(draw.choices(codes, k=draw.randint(2, 9)))
        cut = draw.randint(1, len(text) - 1)
        whole = {(a, b): (c, e) for a, b, c, e in turn_repair.align_block(text, True)}
        parts = turn_repair.join_blocks([turn_repair.align_block(text[:cut], True), turn_repair.align_block(text[cut:])])
        joined = {(a, b): (c, e) for a, b, c, e in parts}
        assert all(joined[k] == v for k, v in whole.items() if k[1] in (turn_repair.NOTHING, turn_repair.ASSISTANT))


# ---- byte-level BPE ----

@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS.removeprefix("file://"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def strange_texts(seed, n):
    draw = random.Random(seed)
    alphabet = ["'", "'", "s", "t", "re", "ve", "ll", "l", "r", "v", "e", "m", "d", "x", "S", " ", " ", "\n", "\t", "\xa0", "　", "1", "٣", "½",
                "é", "日本", "!", "#", "Ᲊ", "\x1c", "\x00", "😀", "\r\n", "<|endoftext|>"]
    return ["".join(draw.choices(alphabet, k=draw.choice((0, 1, 2, 3, 10, 60, 130)))) for _ in range(n)]


@pytest.mark.parametrize(("block", "row", "heap"), [(40, 8, 6), (1, 3, 64), (1 << 18, 256, 64)])
def test_bpe_encoder(library, monkeypatch, block, row, heap):
    for name, value in (("BLOCK_CHARS", block), ("ROW_CHARS", row), ("HEAP_BYTES", heap), ("CACHE_WORDS", 200)):
        monkeypatch.setattr(byte_bpe, name, value)
    ranks, plain = library
    encoder = byte_bpe.Encoder(ranks, byte_bpe.Pairs(ranks), byte_bpe.class_runs())
    texts = strange_texts(block, 600)
    for i in range(0, len(texts), 7):
        some = texts[i:i + 7]
        assert [x.tolist() for x in encoder.encode(some)] == [plain.encode_ordinary(t) for t in some]
    draw = random.Random(3)
    for text in ("".join(draw.choices("abcdefgh", k=3000)), "x" * 3000 + "  '", " " * 2000 + "a", "'" * 500, "'ll" * 300):
        ids = encoder.encode([text])[0]
        assert ids.tolist() == plain.encode_ordinary(text)
        assert encoder.ends(ids)[-1] == len(text.encode())


def test_scan_is_the_fold():
    draw = random.Random(4)
    for n in (1, 2, 7, 255, 256, 257, 70_000):
        kinds = np.array(draw.choices(range(10), k=n))
        states, state = [], byte_bpe.AT_START
        for k in kinds.tolist():
            states.append(state)
            state = byte_bpe._next_state(state, k)
        assert byte_bpe.STATE_AFTER[byte_bpe.scan(byte_bpe.OF_CLASS[kinds])].tolist() == states


def test_bpe_frames(spark, library):
    _, plain = library
    texts = [None, "", *strange_texts(9, 60), "word " * 30_000]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "null id", "x", 7), (3, "again", "y", 7), (3, "again", "y", 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, n_tokens int").repartition(3)
    got = sorted(byte_bpe.round_trip_digests(frame).collect(), key=str)
    want = []
    for i, t, _, _ in rows:
        ids = plain.encode_ordinary(t or "")
        sums = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (t or "").encode())]
        want.append((i, len(ids), *sums))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(spark_row(*r)))
    encoded = byte_bpe.encode_texts(frame, ("doc_id", "_text", "n_tokens"))
    for r in encoded.where("doc_id = 20").collect():
        data, begins = texts[20].encode(), [0, *r.ends]
        assert [data[a:b] for a, b in itertools.pairwise(begins)] == [plain.decode_single_token_bytes(i) for i in r.ids]
    assert byte_bpe.round_trip_digests(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="names of the result"):
        byte_bpe.encode_texts(frame.withColumn("ids", frame.text), ("ids",))


def spark_row(*values):
    from pyspark.sql import Row

    return Row("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")(*values)


# ---- whitening ----

def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    n = len(x)
    y = x - x.mean(0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    ints = [[int(c) for c in r] for r in x]
    sums = [sum(c) for c in zip(*ints, strict=True)]
    return e, y @ v[:, :most] / np.sqrt(np.maximum(e[:most], 1e-300)), [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in ints]


def whitened_matrix(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, np.zeros(k))[r.component - 1] = r.whitened
    return out


def test_whitening(spark):
    draw = np.random.default_rng(7)
    scale = np.concatenate(([40.0, 11.0], np.linspace(3, 1, 32)))
    good = (draw.normal(size=(500, 34)) * scale @ np.linalg.qr(draw.normal(size=(34, 34)))[0]).astype(np.float32).tolist()
    rows = [(i, v, "x") for i, v in enumerate(good)]
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], [1.0, 2.0], [], [3e30] + good[0][1:]]
    frame = spark.createDataFrame(rows + [(1000 + i, v, "x") for i, v in enumerate(bad)], "vec_id bigint, embedding array<float>, x string").repartition(4)
    got = whitening.whiten(frame).collect()
    e, w, away = plain_whitening(good)
    assert len(got) == 500 * 32 and {r.n for r in got} == {500}
    found = whitened_matrix(got, 32)
    mine = np.array([found[i] for i in range(500)])
    for c in range(32):
        sign = np.sign(mine[:, c] @ w[:, c])
        assert np.allclose(sign * mine[:, c], w[:, c], rtol=0, atol=1e-9)
    assert {(r.component, True) for r in got} == {(c + 1, True) for c in range(32)}
    for r in got:
        assert np.isclose(r.explained, e[r.component - 1] / e.sum(), rtol=1e-10) and r.deviation == away[r.vec_id] and r.identity_error < 1e-10


def test_whitening_of_dependent_and_equal_dimensions(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(300, 3))
    dependent = np.column_stack((base, base[:, 0], np.full(300, 0.5), base[:, 1] * 0 + 2))
    equal = np.vstack([np.eye(12)] * 5)  # one variance eleven times, and one of zero
    for vectors, rank in ((dependent, 3), (equal, 11)):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id int, embedding array<double>")
        got = whitening.whiten(frame).collect()
        e, _, _ = plain_whitening(vectors)
        assert len(got) == rank * len(vectors) and all(r.identity_error < 1e-9 for r in got)
        for c in range(1, rank + 1):
            assert np.isclose(next(r.explained for r in got if r.component == c), e[c - 1] / e.sum(), rtol=1e-9)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (None, None)], "vec_id int, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [3.0, 2.0])], "vec_id int, embedding array<double>")
    assert [(r.vec_id, r.component, r.n) for r in whitening.whiten(twice).orderBy("vec_id").collect()] == [(None, 1, 3), (None, 1, 3), (5, 1, 3)]


def test_deviation_beyond_64_bits(spark):
    vectors = [[1e14, 0.0], [-1e14, 1.0], [5.0, 2.0]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>")).collect()
    _, _, away = plain_whitening(vectors)
    assert all(r.deviation is None for r in got if away[r.vec_id] >= 1 << 63) and len(got) == 3  # the second variance is nothing beside the first
