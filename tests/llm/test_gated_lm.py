"""The network of op6 against plain loops, and how often its outputs are worked out."""

import math

import numpy as np
import pytest

from logharbor.llm import gru_lm


def _ids(n, most, seed):
    return np.minimum(most - 1, (most * np.random.default_rng(seed).random(n) ** 3).astype(int))


def _calls(monkeypatch, run):
    calls, real = [], gru_lm._softmax
    monkeypatch.setattr(gru_lm, "_softmax", lambda *a: calls.append(1) or real(*a))
    run()
    return len(calls)


def test_outputs_of_long_texts_are_worked_out_together(monkeypatch):
    model = gru_lm.GatedModel(np.arange(1, 400))
    # One window after the other took over 20 calls for each of 209 windows.
    assert _calls(monkeypatch, lambda: model.log_likelihood([_ids(5_000, 399, 1)])) < 100


def test_classes_of_few_states_are_learnt_side_by_side(monkeypatch):
    model = gru_lm.GatedModel(np.arange(2_000, 0, -1))
    # Four windows of 45 classes: one class after the other took over 150 calls.
    assert _calls(monkeypatch, lambda: model.fit([_ids(960, 2_000, 2)], lanes=10)) < 60


@pytest.mark.parametrize("scale", [0.2, 5.0])
def test_probabilities_for_every_size_of_class_and_logit(scale, monkeypatch):
    draw = np.random.default_rng(4)
    model = gru_lm.GatedModel(np.arange(300, 0, -1))
    model.w = {k: w.astype(float) + draw.normal(0, scale, w.shape) * (np.abs(w) < 1e8) for k, w in model.w.items()}
    states, ids = draw.uniform(-1, 1, (700, gru_lm.UNITS)), _ids(700, 300, 5)
    want = np.empty(700)
    for i, (state, word) in enumerate(zip(states, ids, strict=True)):
        c, p = model.klass[word], model.place[word]
        want[i] = 0
        for weights, at in [(model.w["class"], c)] + [(model.w["word"][c], p)] * int(c > 0):
            logits = np.append(state, 1) @ weights
            want[i] += logits[at] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
    for few, block in ((128, 1_024), (0, 1_024), (4, 16), (128, 64)):
        monkeypatch.setattr(gru_lm, "FEW_STATES", few)
        monkeypatch.setattr(gru_lm, "BLOCK_STATES", block)
        assert np.allclose(model.outputs(states, ids)[0], want, atol=1e-9)


def test_fit_is_plain_adam(monkeypatch):
    monkeypatch.setattr(gru_lm, "BLOCK_WEIGHTS", 700)
    ids = _ids(480, 60, 6)
    model, plain = gru_lm.GatedModel(np.arange(60, 0, -1)), gru_lm.GatedModel(np.arange(60, 0, -1))
    model.fit([ids], 1e-3, lanes=4)
    lanes, before = ids.reshape(4, 120).T, np.concatenate(([gru_lm.END], ids[:-1])).reshape(4, 120).T
    state, means = np.zeros((4, gru_lm.UNITS), np.float32), {k: [np.zeros(w.shape), np.zeros(w.shape)] for k, w in plain.w.items()}
    for step in range(1, 6):
        at = slice((step - 1) * gru_lm.WINDOW, step * gru_lm.WINDOW)
        grads, _, state = plain.slopes(before[at], lanes[at], np.ones((gru_lm.WINDOW, 4), bool), state)
        norm = math.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in grads.values()))
        for k, g in grads.items():
            moved = np.isin(np.arange(60), before[at])[:, None] if k == "input" else np.True_
            g, (m, v) = g * min(1, 1 / norm), means[k]
            m += moved * 0.1 * (g - m)
            v += moved * 0.01 * (g * g - v)
            rate = 1e-3 * (1 - 0.9 * step / 5) / (1 - 0.9 ** step)
            plain.w[k] = (plain.w[k] - moved * rate * m / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    fresh = gru_lm.GatedModel(np.arange(60, 0, -1))
    for k, w in plain.w.items():
        assert np.allclose(model.w[k], w, atol=2e-5) and not np.array_equal(w, fresh.w[k])


def test_sums_by_id_and_places_of_words():
    draw = np.random.default_rng(7)
    ids, slopes = _ids(900, 70, 8), draw.normal(size=(3, 900, gru_lm.UNITS))
    rows, sums = gru_lm._sums_by_id(slopes, ids)
    want = np.zeros((70, 3 * gru_lm.UNITS))
    np.add.at(want, ids, gru_lm._joined(slopes))
    assert sorted(rows.tolist()) == np.unique(ids).tolist() and np.allclose(sums, want[rows])
    for n in (0, 1, 5, 1_000):
        words = np.sort(draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        hashes = np.concatenate((words, words + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)))
        at, found = gru_lm.WordPlaces(words).find(hashes)
        assert np.array_equal(at, np.searchsorted(words, hashes)) and np.array_equal(found, np.isin(hashes, words))
