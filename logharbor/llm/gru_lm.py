"""Log-likelihood of whole documents under a gated recurrent language model, in numpy.

The output is factored: classes of words, then the words of a class. Words beyond
the model's vocabulary are one class, inside which a word's probability is its
smoothed share of the corpus counts, which are taken over all training documents.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import SpanHash, by_size, crc_mod, doc_slices, small_batches, text_bytes, written

UNITS = 32
# Words of the model's own: this times the square root of the training tokens, at most HEAD. Classes are about the root of their number.
MODEL_SCALE = 1.0
OTHER, END = 0, 1  # ids of any word beyond the vocabulary, and of the end of a text
# States whose outputs are worked out at once.
BLOCK_STATES = 1_024
# States kept until their outputs are worked out, and weights moved at once.
STATES_AT_ONCE = 1 << 15
BLOCK_WEIGHTS = 1 << 15
# Classes of up to so many states are worked out together.
FEW_STATES = 128
# Rows of one id in a window from which they are added up by themselves.
FEW_ROWS = 16
# Sums of exp below this, and above its inverse, need no shift by the largest logit.
SAFE_SUM = 1e15
# Steps through which a gradient flows; the state goes on from window to window.
WINDOW = 24
# Runs of text learnt from side by side: by a task, and by the first fit, which makes more and smaller steps.
LANES = 512
FIRST_LANES = 48
# Bound of the sample, in documents and in tokens, from which the weights begin that all training texts then teach.
FIT_DOCS = 1_500
FIT_TOKENS = 900_000
RATE = 6e-3
# The pass over all training texts: its rate, tokens learnt from at once by a task, and the longest stretch of a text with one state.
PASS_RATE = 1.5e-3
PASS_TOKENS = 400_000
PASS_STRETCH = 4_096
# The texts are dealt to so many rounds; after each, the weights of all tasks are averaged.
ROUNDS = 2
# Tokens that a task learns from, at least, for each weight that it sends: what moves stays a fraction of the texts.
TOKENS_PER_WEIGHT = 3
# Weights that move as one row when those of all tasks are averaged.
SLICE_WEIGHTS = 1 << 14
# Words of the corpus whose counts go to every task; the counts of the others come by a join.
HEAD = 200_000
# Words sorted and counted at once by a task.
COUNTED_AT_ONCE = 2_000_000
# Tokens scored side by side by a task.
BUFFER_TOKENS = 1_500_000


def _classes_of(n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Class and place in it of each id, and the words of a class: the other words alone, the rest in blocks by rank."""
    ids, size = np.arange(n), max(1, math.ceil(math.sqrt(n - 1)))
    return np.where(ids == OTHER, 0, 1 + (ids - 1) // size), np.where(ids == OTHER, 0, (ids - 1) % size), size


def _split(x: np.ndarray) -> np.ndarray:
    """Columns of the update gate, the reset gate and the candidate, each as an array of its own: [gate, row, unit]."""
    return np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))


def _joined(x: np.ndarray) -> np.ndarray:
    """The reverse of ``_split``."""
    return np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(x.shape[1], -1)


def _gru(gates: np.ndarray, own: np.ndarray, recurrent: np.ndarray, state: np.ndarray, after: np.ndarray) -> None:
    """One step in place. ``gates`` come as what the inputs give and end as update gate, reset gate and candidate;
    ``own``, used up, and ``recurrent`` are what the state gives to the gates and to the candidate; the new state goes to ``after``."""
    both, (z, r, candidate) = gates[:2], gates
    both += own
    # The logistic function by the hyperbolic tangent, which neither overflows nor divides.
    both *= 0.5
    np.tanh(both, out=both)
    both += 1
    both *= 0.5
    np.multiply(r, recurrent, out=own[0])
    candidate += own[0]
    np.tanh(candidate, out=candidate)
    np.subtract(state, candidate, out=after)
    after *= z
    after += candidate


def _in_order(ids: np.ndarray) -> np.ndarray:
    """Stable order of small numbers; in 16 bits numpy counts digits instead of comparing."""
    return np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")


def _sums_by_id(slopes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the rows [gate, row, unit] of each added up and joined."""
    order = _in_order(ids)
    found = ids[order]
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    sizes = np.diff(starts, append=len(ids))
    by = np.argsort(-sizes, kind="stable")
    starts, sizes, rows = starts[by], sizes[by], np.take(slopes, order, axis=1)
    sums = np.take(rows, starts, axis=1)
    # Ids of many rows one by one; of the others the second rows of all, then the third ones.
    many = int(np.searchsorted(-sizes, -FEW_ROWS, "left"))
    for i, (a, n) in enumerate(zip(starts[:many].tolist(), sizes[:many].tolist(), strict=True)):
        sums[:, i] = np.ones(n, rows.dtype) @ rows[:, a:a + n]
    for j in range(1, FEW_ROWS):
        stop = int(np.searchsorted(-sizes, -j, "left"))
        if stop <= many:
            break
        sums[:, many:stop] += np.take(rows, starts[many:stop] + j, axis=1)
    return found[starts], _joined(sums)


def _adam(weights: np.ndarray, slopes: np.ndarray, m: np.ndarray, v: np.ndarray, scale: float, rate: float, late: float) -> None:
    """One step in place, all arrays flat, in blocks that stay in the cache; ``slopes`` are used up.

    ``m`` and ``v`` are 10 and 100 times the running means, so that new slopes are added as they are.
    """
    for a in range(0, len(weights), BLOCK_WEIGHTS):
        w, g, mean, square = (x[a:a + BLOCK_WEIGHTS] for x in (weights, slopes, m, v))
        g *= scale
        mean *= 0.9
        mean += g
        g *= g
        square *= 0.99
        square += g
        np.sqrt(square, out=g)
        g += 1e-7 / late
        np.divide(mean, g, out=g)
        g *= rate / late
        w -= g


def _softmax(states: np.ndarray, weights: np.ndarray, wanted: np.ndarray, learn: bool, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log probability of the wanted column of each row, flat; while learning, also the slopes of the weights and at the states.

    States end with a one and weights with the bias. With one more dimension before, it holds classes of as many rows.
    """
    columns = weights.shape[-1]
    logits, ones = room[:wanted.size * columns].reshape(*wanted.shape, columns), np.ones(columns, room.dtype)
    flat, at = logits.reshape(-1), np.arange(wanted.size) * columns + wanted.ravel()
    for shifted in (False, True):
        np.matmul(states, weights, out=logits)
        if shifted:
            logits -= logits.max(-1, keepdims=True)
        logs = flat[at]
        with np.errstate(over="ignore"):
            np.exp(logits, out=logits)
            total = logits.reshape(-1, columns) @ ones
        if total.max() < SAFE_SUM and total.min() > 1 / SAFE_SUM:
            break
    logs -= np.log(total)
    if not learn:
        return logs, None, None
    # The division by the total is made where there are fewer columns: before one product, after the other.
    flat[at] -= total
    total = total.reshape(*wanted.shape, 1)
    slopes = (states / total).swapaxes(-1, -2) @ logits
    back = logits @ weights[..., :-1, :].swapaxes(-1, -2)
    back /= total
    return logs, slopes, back


class GatedModel:
    """Weights and passes; ids are 0 for other words, 1 for the end, then words by falling count."""

    def __init__(self, counts: np.ndarray, seed: int = 3) -> None:
        draw = np.random.default_rng(seed)
        n, h = len(counts), UNITS
        self.klass, self.place, size = _classes_of(n)
        self.classes = int(self.klass[-1]) + 1
        share = (counts + 1.0) / (counts + 1.0).sum()
        class_share = np.bincount(self.klass, share, self.classes)
        word_bias = np.full((self.classes, 1, size), -1e9)
        word_bias[self.klass, 0, self.place] = np.log(share)
        self.w = {
            "input": draw.normal(0, 0.1, (n, 3 * h)), "input_bias": np.concatenate((np.full(h, 1.0), np.zeros(2 * h))),
            "state": draw.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            # The last unit before an output layer is always one: its weights are the bias.
            "class": np.concatenate((draw.normal(0, 0.05, (h, self.classes)), np.log(np.maximum(class_share, 1e-30))[None])),
            "word": np.concatenate((draw.normal(0, 0.05, (self.classes, h, size)), word_bias), 1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def weights(n: int) -> int:
        """How many weights a model of ``n`` ids has, about."""
        return n * (4 * UNITS + 1)

    def step(self, gates: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Update gate, reset gate, candidate, its recurrent part, new state. ``gates`` are inputs."""
        gates, own, after = _split(gates), state @ _split(self.w["state"]), np.empty_like(state)
        _gru(gates, own[:2], own[2], state, after)
        return *gates, own[2], after

    def outputs(self, states: np.ndarray, ids: np.ndarray, learn: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each id after each state; while learning, also the slopes at the states, and those of the weights are added to ``learn``.

        Both layers run in blocks that stay in the cache, and in place.
        """
        out = np.empty(len(ids), states.dtype)
        back = None if learn is None else np.empty_like(states)
        if not len(ids):
            return out, back
        # Ids in order of their class: the words of a class are one run. A row of zeros fills up classes of few states.
        klass, n = self.klass[ids], len(ids)
        order = _in_order(klass)
        klass, place = klass[order], np.append(self.place[ids[order]], 0)
        inner = np.zeros((n + 1, UNITS + 1), states.dtype)
        inner[:n, :-1] = states[order]
        inner[:n, -1] = 1
        logs, inner_back = np.zeros(n + 1, states.dtype), None if learn is None else np.zeros((n + 1, UNITS), states.dtype)
        top, words = self.w["class"], self.w["word"]
        room = np.empty(max(BLOCK_STATES, FEW_STATES) * max(self.classes, words.shape[-1]), states.dtype)
        for a in range(0, n, BLOCK_STATES):
            part = slice(a, min(a + BLOCK_STATES, n))
            logs[part], slopes, back_part = _softmax(inner[part], top, klass[part], learn is not None, room)
            if learn is not None:
                learn["class"] += slopes
                inner_back[part] = back_part
        bounds = np.searchsorted(klass, np.arange(self.classes + 1))
        sizes = np.diff(bounds)
        for c in 1 + np.flatnonzero(sizes[1:] > FEW_STATES):
            for a in range(bounds[c], bounds[c + 1], BLOCK_STATES):
                part = slice(a, min(a + BLOCK_STATES, bounds[c + 1]))
                more, slopes, back_part = _softmax(inner[part], words[c], place[part], learn is not None, room)
                logs[part] += more
                if learn is not None:
                    learn["word"][c] += slopes
                    inner_back[part] += back_part
        # Classes of few states side by side, those of like numbers together.
        few = 1 + np.flatnonzero((sizes[1:] > 0) & (sizes[1:] <= FEW_STATES))
        few = few[np.argsort(sizes[few], kind="stable")]
        while len(few):
            most = 1 << int(sizes[few[0]] - 1).bit_length()
            some = few[:min(int(np.searchsorted(sizes[few], most, "right")), max(1, BLOCK_STATES // most))]
            few, steps = few[len(some):], np.arange(int(sizes[some[-1]]))
            part = np.where(steps < sizes[some][:, None], bounds[some][:, None] + steps, n)
            more, slopes, back_part = _softmax(inner[part], words[some], place[part], learn is not None, room)
            logs[part.ravel()] += more
            if learn is not None:
                learn["word"][some] += slopes
                inner_back[part] += back_part
        out[order] = logs[:n]
        if learn is not None:
            back[order] = inner_back[:n]
        return out, back

    def slopes(self, before: np.ndarray, ids: np.ndarray, real: np.ndarray, state: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """One window [step, lane]: gradients of the mean loss, the loss, the state after it.

        ``before`` are the ids read, ``ids`` those to be predicted where ``real``.
        """
        grads = {k: np.zeros_like(w) for k, w in self.w.items()}
        rows, grads["input"][rows], n, loss, state = self._slopes(before, ids, real, np.zeros_like(real), state, grads, {})
        return {k: g / n for k, g in grads.items()}, loss, state

    def _slopes(self, before: np.ndarray, ids: np.ndarray, real: np.ndarray, fresh: np.ndarray, state: np.ndarray, grads: dict,
                room: dict) -> tuple[np.ndarray, np.ndarray, int, float, np.ndarray]:
        """One window: the ids read and the slopes of their rows, how many ids are predicted, their mean loss, the state after it.

        Slopes are of the loss summed; those of all other weights are added to ``grads``.
        Where ``fresh``, a text begins: the state is zero before. ``room`` keeps arrays from window to window.
        """
        h, (steps, lanes) = UNITS, ids.shape
        kind = state.dtype

        def kept(name, *shape):
            if name not in room or room[name].shape != shape:
                room[name] = np.empty(shape, kind)
            return room[name]

        gates, own, every, priors = kept("gates", 3, steps, lanes, h), kept("own", steps, lanes, h), kept("every", steps, lanes, h), []
        read, some, weights = kept("read", lanes, 3 * h), kept("some", 3, lanes, h), _split(self.w["state"])
        bias = self.w["input_bias"].reshape(3, 1, h)
        begun = fresh.any(1).tolist()
        for t in range(steps):
            prior = np.where(fresh[t][:, None], kind.type(0), state) if begun[t] else state
            priors.append(prior)
            np.take(self.w["input"], before[t], axis=0, out=read, mode="clip")
            np.add(read.reshape(lanes, 3, h).transpose(1, 0, 2), bias, out=gates[:, t])
            np.matmul(prior, weights[:2], out=some[:2])
            np.matmul(prior, weights[2], out=own[t])
            state = every[t]
            _gru(gates[:, t], some[:2], own[t], prior, state)
        state, whole = state.copy(), bool(real.all())
        logs, back = self.outputs(every.reshape(-1, h) if whole else every[real], ids.ravel() if whole else ids[real], grads)
        if whole:
            flow = back.reshape(steps, lanes, h)
        else:
            flow = np.zeros_like(every)
            flow[real] = back
        later, through, less, weights = np.zeros((lanes, h), kind), kept("through", lanes, h), kept("less", lanes, h), np.ascontiguousarray(weights.transpose(0, 2, 1))
        at_state, more = np.zeros_like(weights), np.empty_like(weights)
        for t in range(steps - 1, -1, -1):
            # The slopes at the gates take the place of the gates; ``through`` ends as those at the state's part of the candidate.
            z, r, candidate = gates[:, t]
            d, recurrent = flow[t], own[t]
            d += later
            np.multiply(d, z, out=later)
            np.subtract(d, later, out=through)
            np.subtract(priors[t], candidate, out=less)
            z *= less
            z *= through
            candidate *= candidate
            np.subtract(1, candidate, out=candidate)
            candidate *= through
            np.multiply(candidate, r, out=through)
            np.subtract(1, r, out=r)
            r *= recurrent
            r *= through
            np.matmul(priors[t].T, gates[:2, t], out=more[:2])
            np.matmul(priors[t].T, through, out=more[2])
            at_state += more
            np.matmul(gates[:2, t], weights[:2], out=some[:2])
            np.matmul(through, weights[2], out=some[2])
            later += some[0]
            later += some[1]
            later += some[2]
            if begun[t]:
                later[fresh[t]] = 0
        grads["state"] += _joined(at_state)
        rows, sums = _sums_by_id(gates.reshape(3, -1, h), before.ravel())
        grads["input_bias"] += sums.sum(0)
        n = max(1, len(logs))
        return rows, sums, n, float(-logs.sum() / n), state

    def fit(self, texts: list[np.ndarray], most: float = RATE, lanes: int | None = None) -> GatedModel:
        """Truncated backpropagation, one pass, by Adam: the texts in a row, cut into lanes of one length.

        Rows of the inputs move only in steps that read them.
        """
        texts = [t for t in texts if len(t)]
        if not texts:
            return self
        flat = np.concatenate(texts)
        begins = np.cumsum([0, *map(len, texts[:-1])])
        lanes = max(1, min(lanes or LANES, len(flat) // WINDOW))
        length = -(-len(flat) // lanes)
        pad = lanes * length - len(flat)
        before = np.concatenate(([END], flat[:-1]))
        before[begins] = END
        first, real = np.zeros(len(flat), bool), np.ones(len(flat), bool)
        first[begins] = True

        def laid(x, fill):
            return np.ascontiguousarray(np.concatenate((x, np.full(pad, fill, x.dtype))).reshape(lanes, length).T)

        before, ids, first, real = laid(before, END), laid(flat, END), laid(first, True), laid(real, False)
        # All weights but the input rows lie in one row, as do their slopes and means.
        others = sorted(k for k in self.w if k != "input")
        row, inputs = np.concatenate([self.w[k].ravel() for k in others]), [self.w["input"], *np.zeros((2, *self.w["input"].shape), np.float32)]
        slopes, (m, v) = np.zeros_like(row), np.zeros((2, *row.shape), row.dtype)
        grads, at = {}, 0
        for k in others:
            part, shape = slice(at, at + self.w[k].size), self.w[k].shape
            self.w[k], grads[k], at = row[part].reshape(shape), slopes[part].reshape(shape), part.stop
        state, room, total = np.zeros((lanes, UNITS), np.float32), {}, -(-length // WINDOW)
        for step in range(1, total + 1):
            a, b = (step - 1) * WINDOW, min(length, step * WINDOW)
            slopes[...] = 0
            rows, sums, n, _, state = self._slopes(before[a:b], ids[a:b], real[a:b], first[a:b], state, grads, room)
            norm = math.sqrt(float(np.vdot(slopes, slopes)) + float(np.vdot(sums, sums))) / n
            scale = min(1.0, 1.0 / max(norm, 1e-9)) / n
            rate = most * (1 - 0.9 * step / total) / (1 - 0.9 ** step)
            late = 1 / math.sqrt(1 - 0.99 ** step)
            _adam(row, slopes, m, v, scale, rate, late)
            few = max(1, BLOCK_WEIGHTS // (3 * UNITS))
            for a in range(0, len(rows), few):
                some = rows[a:a + few]
                now = [np.take(x, some, axis=0) for x in inputs]
                _adam(now[0].reshape(-1), sums[a:a + few].reshape(-1), now[1].reshape(-1), now[2].reshape(-1), scale, rate, late)
                for x, y in zip(inputs, now, strict=True):
                    x[some] = y
        return self

    def log_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole text; one state runs through it to its end."""
        out = np.zeros(len(texts))
        order = np.array(sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i])), np.int64)
        inputs, weights = _split(self.w["input"] + self.w["input_bias"]), _split(self.w["state"])
        for first in range(0, len(order), LANES):
            some = order[first:first + LANES]
            out[some] = self._run([texts[i] for i in some], inputs, weights)
        return out

    def _run(self, texts: list[np.ndarray], inputs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """``log_likelihood`` of texts by falling length, side by side: at each step those that still have an id are the first ones."""
        sizes, flat = np.array([len(t) for t in texts]), np.concatenate(texts)
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        begins, offsets = np.cumsum(sizes) - sizes, np.cumsum(alive) - alive
        # Ids in order of their steps.
        lane = np.repeat(np.arange(len(texts)), sizes)
        place = offsets[np.arange(len(flat)) - begins[lane]] + lane
        ids, owner, before = np.empty_like(flat), np.empty_like(lane), np.empty_like(flat)
        ids[place], owner[place], before[place] = flat, lane, np.concatenate(([END], flat[:-1]))
        before[:alive[0]] = END
        sums, kind = np.zeros(len(texts)), inputs.dtype
        states = np.empty((max(STATES_AT_ONCE, alive[0]), UNITS), kind)
        gates_room, own_room = np.empty((2, 3 * alive[0] * UNITS), kind)
        state, done, held = np.zeros((alive[0], UNITS), kind), 0, 0
        for n in alive.tolist():
            if held + n > len(states):
                state = state.copy()
                sums += self._sums(states[:held], ids[done:done + held], owner[done:done + held], len(texts))
                done, held = done + held, 0
            gates, own = (x[:3 * n * UNITS].reshape(3, n, UNITS) for x in (gates_room, own_room))
            np.take(inputs, before[done + held:done + held + n], axis=1, out=gates, mode="clip")
            np.matmul(state[:n], weights, out=own)
            after = states[held:held + n]
            _gru(gates, own[:2], own[2], state[:n], after)
            state, held = after, held + n
        return sums + self._sums(states[:held], ids[done:], owner[done:], len(texts))

    def _sums(self, states: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, self.outputs(states, ids)[0], n)


def _word_counts(batches):
    """(hash, count) of the words of all texts, summed per task before rows move."""
    spans, held, seen, size = SpanHash(), [], [], 0

    def counted():
        hashes = np.sort(np.concatenate(seen))
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        return hashes[starts], np.diff(starts, append=len(hashes))

    def merged():
        if len(held) == 1:
            return held[0]
        words = np.concatenate([w for w, _ in held])
        counts = np.concatenate([c for _, c in held])
        unique, at = np.unique(words, return_inverse=True)
        return unique, np.bincount(at, counts, len(unique)).astype(np.int64)

    def batch_of(words, counts):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

    for batch in batches:
        texts = batch.column("_text").to_pylist()
        for first, stop in by_size(texts):
            hashes, _ = spans.words([t.lower() for t in texts[first:stop]])
            seen.append(hashes)
            size += len(hashes)
            if size >= COUNTED_AT_ONCE:
                held.append(counted())
                seen, size = [], 0
        if sum(len(w) for w, _ in held) > 2_000_000:
            words, counts = merged()
            held = [(words, counts)]
            if len(words) > 1_000_000:
                yield batch_of(words, counts)
                held = []
    if size:
        held.append(counted())
    if held:
        yield batch_of(*merged())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): the 64-bit hash of each lower-cased word of all texts, and how often it occurs."""
    return docs.select(text_bytes().alias("_text")).mapInArrow(_word_counts, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class WordPlaces:
    """Places of hashes among sorted ones, as ``np.searchsorted`` gives them: their first bits say where to begin, and few steps are left."""

    def __init__(self, words: np.ndarray) -> None:
        bits = (2 * len(words) + 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.n, self.words = len(words), np.append(words, np.uint64((1 << 64) - 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there; the place of others may be one beyond the last."""
        at = self.first[hashes >> self.shift]
        left = np.flatnonzero(self.words[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[self.words[at[left]] < hashes[left]]
        return at, (self.words[at] == hashes) & (at < self.n)


class Vocabulary:
    """Counts of the commonest words, and the model's ids of the first of them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, texts: int, tokens: int | None = None) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.tokens = int(counts.sum()) + texts if tokens is None else tokens
        # Rows come by falling count, so ids do too.
        ids = np.arange(len(words)) + 2
        self.ids = np.where(ids < 2 + math.ceil(MODEL_SCALE * math.sqrt(self.tokens)), ids, OTHER)[order]
        self.texts = texts
        own = self.ids != OTHER
        self.model_size = 2 + int(own.sum())
        self.own_words, self.own_ids = self.words[own], np.append(self.ids[own], OTHER)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, WordPlaces)}

    @cached_property
    def places(self) -> WordPlaces:
        return WordPlaces(self.words)

    @cached_property
    def own_places(self) -> WordPlaces:
        return WordPlaces(self.own_words)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1 if not held here) and model id of each word."""
        if not len(self.words):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        at, found = self.places.find(hashes)
        at[~found] = 0
        return np.where(found, self.counts[at], -1), np.where(found, self.ids[at], OTHER)

    def model_ids(self, hashes: np.ndarray) -> np.ndarray:
        """As the ids of ``look_up``, by a search of the model's own words only."""
        at, found = self.own_places.find(hashes)
        return np.where(found, self.own_ids[at], OTHER)


def _score(vocabulary: Vocabulary, model: GatedModel, keep: list[str]):
    """Per text: tokens, what the held counts and the network give, and the words whose counts must be joined."""
    def rows(batches):
        spans = SpanHash()
        log_texts = math.log10(vocabulary.texts + 1)
        kept, ids, done, size = [], [], [], 0

        def flush():
            n = len(ids)
            logs = model.log_likelihood(ids) / math.log(10)
            n_tokens, n_known, sums, other_sums, n_other = (pa.array([d[i] for d in done]) for i in range(5))
            bounds = np.concatenate(([0], np.cumsum([len(d[5]) for d in done]))).astype(np.int32)
            tails = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *(d[5] for d in done)])))
            columns = [pa.concat_arrays([k.column(c) for k in kept]) for c in keep]
            assert all(len(c) == n for c in columns)
            return pa.RecordBatch.from_arrays(
                [*columns, n_tokens, n_known, sums, other_sums, n_other, pa.array(logs), tails],
                names=[*keep, "n_tokens", "n_known", "sums", "other_sums", "n_other", "logs", "tail"])

        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for first, stop in by_size(texts):
                hashes, owners = spans.words([t.lower() for t in texts[first:stop]])
                counts, model_ids = vocabulary.look_up(hashes)
                here = counts >= 0
                logs, other = np.where(here, np.log10(np.maximum(counts, 0) + 1.0), 0.0), model_ids == OTHER
                cuts = doc_slices(owners, stop - first).tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    seen, out = here[a:b], other[a:b]
                    done.append((b - a + 1, int(seen.sum()) + (vocabulary.texts > 0), float(logs[a:b].sum()) + log_texts,
                                 float(logs[a:b][out].sum()), int(out.sum()), hashes[a:b][~seen].view(np.int64)))
                    ids.append(np.append(model_ids[a:b], END))
                    size += b - a + 1
            kept.append(batch.select(keep))
            if size >= BUFFER_TOKENS:
                yield flush()
                kept, ids, done, size = [], [], [], 0
        if ids:
            yield flush()

    return rows


def _fit_ids(docs: DataFrame, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Model ids of the bounded training sample, whole texts by hash of their ids."""
    picked = written(docs.select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(FIT_DOCS).select("doc_id").distinct(), "fit")
    rows = docs.select("doc_id", text_bytes().alias("_text")).join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(2 * FIT_DOCS).collect()
    spans, out, total = SpanHash(), [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id % 1009, r.doc_id, bytes(r._text))):
        hashes, _ = spans.words([bytes(r._text).lower()])
        if total + len(hashes) < FIT_TOKENS:
            total += len(hashes) + 1
            out.append(np.append(vocabulary.look_up(hashes)[1], END))
    return out


def _learn(vocabulary: Vocabulary, model: GatedModel):
    """Slices of the weights after all texts of a task, times the tokens learnt from."""
    def rows(batches):
        from pyspark import TaskContext

        spans, held, size, total = SpanHash(), [], 0, 0
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for first, stop in by_size(texts):
                hashes, owners = spans.words([t.lower() for t in texts[first:stop]])
                ids, cuts = vocabulary.model_ids(hashes), doc_slices(owners, stop - first).tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    whole = np.append(ids[a:b], END)
                    for at in range(0, len(whole), PASS_STRETCH):
                        held.append(whole[at:at + PASS_STRETCH])
                        size += len(held[-1])
                        if size >= PASS_TOKENS:
                            model.fit(held, PASS_RATE)
                            held, size, total = [], 0, total + size
        if held:
            model.fit(held, PASS_RATE)
            total += size
        if total:
            flat = np.concatenate([model.w[k].ravel() for k in sorted(model.w)])
            part = TaskContext.get().partitionId()
            for k, at in enumerate(range(0, len(flat), SLICE_WEIGHTS)):
                piece = flat[at:at + SLICE_WEIGHTS].tobytes()
                yield pa.RecordBatch.from_pylist([{"k": k, "part": part, "n": total, "w": piece}])

    return rows


def _sum_slices(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    total = sum(np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * n for w, n in zip(table.column("w"), table.column("n").to_pylist(), strict=True))
    return pa.table({"k": table.column("k")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "w": [total.tobytes()]})


def learn_all(training: DataFrame, vocabulary: Vocabulary, model: GatedModel) -> GatedModel:
    """One pass over all training texts: each task learns from all of its own, then weights are averaged by tokens."""
    slices = (training.select(text_bytes().alias("_text")).mapInArrow(_learn(vocabulary, model), "k bigint, part bigint, n bigint, w binary")
              .groupBy("k").applyInArrow(_sum_slices, "k bigint, n bigint, w binary"))
    found = sorted(slices.collect(), key=lambda r: r.k)  # as many rows as the network has slices
    if found:
        flat, at = np.concatenate([np.frombuffer(r.w) / r.n for r in found]).astype(np.float32), 0
        for k in sorted(model.w):
            shape = model.w[k].shape
            model.w[k] = flat[at:at + model.w[k].size].reshape(shape)
            at += model.w[k].size
    return model


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end, so
    null and empty texts have one token. Counts c, N and V come from all rows whose
    crc32(doc_id as text) mod 7 is not 2. ``base_score`` sums log10((c + 1) / (N + V + 1)).
    ``score`` sums the network's log10 probabilities; a word beyond its vocabulary
    adds log10((c + 1) / (N' + V' + 1)) within its class, N' and V' counting the
    training tokens and words of that class, so unseen words share one more count.

    Rows with a null id teach and are not held out. Repeated rows are scored each.
    Other columns are not read; an empty table gives an empty result; without any
    training text all counts are 0. The network begins from a bounded sample, then all
    training texts teach it, side by side in tasks whose weights are averaged. Of the corpus, counts move by the hash of the
    word, summed per task before; words outside the commonest HEAD bring their
    counts by a join on that hash, where a task may split a frequent one.
    """
    small_batches(docs.sparkSession)
    marked = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    training = marked.where("NOT held_out")
    counts = written(word_counts(training), "counts")
    texts = training.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words + texts, distinct + (texts > 0)
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD).toPandas()
    vocabulary = Vocabulary(head.word.to_numpy(np.int64).view(np.uint64), head.c.to_numpy(np.int64), texts, total)
    in_model = vocabulary.ids != OTHER
    model_counts = np.zeros(vocabulary.model_size, np.int64)
    model_counts[vocabulary.ids[in_model]] = vocabulary.counts[in_model]
    model_counts[END] = texts
    other_words = kinds - vocabulary.model_size + 1 + (texts == 0)
    model_counts[OTHER] = max(0, total - int(model_counts.sum()))
    model = GatedModel(model_counts).fit(_fit_ids(training.where("doc_id IS NOT NULL"), vocabulary), lanes=FIRST_LANES)
    tasks = max(1, round(total / ROUNDS / (TOKENS_PER_WEIGHT * GatedModel.weights(vocabulary.model_size))))
    for r in range(ROUNDS):
        part = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == r)
        model = learn_all(part.coalesce(tasks), vocabulary, model)

    keep = ["_key", "doc_id", "held_out"]
    kind = dict(docs.dtypes)["doc_id"]
    schema = (f"_key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, sums double, other_sums double, "
              "n_other bigint, logs double, tail array<bigint>")
    scored = written(
        marked.select(F.monotonically_increasing_id().alias("_key"), "doc_id", "held_out", text_bytes().alias("_text"))
        .mapInArrow(_score(vocabulary, model, keep), schema), "scored")
    # Tail words of any text against the counts of words outside the head.
    least = int(vocabulary.counts.min()) if len(vocabulary.counts) else 0
    rare = counts.where(F.col("c") <= least)
    found = (
        scored.select("_key", F.explode("tail").alias("word")).join(rare, "word")
        .groupBy("_key").agg(F.count("*").alias("_n"), F.sum(F.log10(F.col("c") + 1)).alias("_sum"))
    )
    joined = scored.drop("tail").join(found, "_key", "left").withColumns(
        {"_n": F.coalesce("_n", F.lit(0)), "_sum": F.coalesce("_sum", F.lit(0.0))})
    base, other = math.log10(total + kinds + 1), math.log10(int(model_counts[OTHER]) + max(0, other_words) + 1)
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("_n")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.col("_sum") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("logs") + F.col("other_sums") + F.col("_sum") - F.col("n_other") * F.lit(other)).alias("score"))
