import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lmscore as L
from tallyspark.llm.queries import op1_lm_scoring

from .corpus import LOWER, awkward, empty, frame, words


def expected(docs, held):
    texts = [words((t or "").translate(LOWER)) + [None] for _, t in docs]
    c = Counter(x for (i, _), w in zip(docs, texts) if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    return n, sorted(((i, held(i), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w in zip(docs, texts)), key=str)


@pytest.mark.parametrize("frequent", [L.FREQUENT, 40])
def test_base_scores_against_brute_force(spark, frequent):
    docs = awkward()
    got = L.score_documents(frame(spark, docs), F.col("doc_id") % 7 == 2, frequent=frequent).collect()
    n, want = expected(docs, lambda i: i is not None and i % 7 == 2)
    assert {r["train_tokens"] for r in got} == {n}
    assert sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_frequent_table_does_not_change_the_scores(spark):
    docs = frame(spark, awkward())
    a, b = ({(r["id"], r["n_tokens"], round(r["score"], 3)) for r in L.score_documents(docs, F.lit(False), frequent=f).collect()} for f in (L.FREQUENT, L.VOCAB + 100))
    assert a == b


def test_empty_table_and_no_training_rows(spark):
    assert L.score_documents(empty(spark), F.lit(False)).count() == 0
    rows = L.score_documents(frame(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}


def vocabulary():
    keys = np.r_[L.END, np.arange(1, 300, dtype=np.uint64) << np.uint64(54)]
    return L.Vocabulary(keys, np.arange(400, 100, -1), np.full(L.RARE, 50.0), np.full(L.RARE, 20.0), 100_000, 5000, False).open()


def test_gradients_against_differences():
    v = vocabulary()
    p = {k: x.astype(np.float64) for k, x in L.initial_parameters(v).items()}
    p["word_b"] = np.maximum(p["word_b"], -20)
    rng = np.random.default_rng(0)
    steps, lanes = 5, 3
    x = rng.integers(0, L.INPUTS, (steps, lanes))
    fresh = rng.random((steps, lanes)) < 0.3
    classes = rng.integers(0, 6, steps * lanes)
    slots = rng.integers(0, L.CLASS_SIZE, steps * lanes)
    h = rng.standard_normal((lanes, L.HIDDEN)) * 0.1

    def loss():
        states = L.forward(p, x, fresh, h)[0].astype(np.float64)
        return -L.outputs(p, states.reshape(-1, L.HIDDEN), classes, slots)[0].sum()

    states, prior, gates, _ = L.forward(p, x, fresh, h)
    grads = {}
    _, back = L.outputs(p, states.reshape(-1, L.HIDDEN), classes, slots, grads)
    L.backward(p, x, fresh, states, prior, gates, back.reshape(steps, lanes, L.HIDDEN), grads)
    for name, at in (("state", (3, 5)), ("state", (2, 40)), ("input", (x[0, 0], 7)), ("class_w", (4, 2)), ("class_b", (3,)), ("word_w", (classes[0], 3, slots[0])), ("word_b", (classes[1], slots[1]))):
        eps = 1e-2
        old = p[name][at]
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at])), name


def test_probabilities_sum_to_one_over_classes_and_slots():
    v = vocabulary()
    p = L.initial_parameters(v)
    s = np.random.default_rng(1).standard_normal((1, L.HIDDEN)).astype(np.float32)
    total = sum(math.exp(L.outputs(p, s, np.array([c]), np.array([-1]))[0][0]) for c in range(L.CLASSES + L.RARE))
    assert abs(total - 1) < 1e-3
    inside = sum(math.exp(L.outputs(p, s, np.array([0]), np.array([k]))[0][0] - L.outputs(p, s, np.array([0]), np.array([-1]))[0][0]) for k in range(L.CLASS_SIZE))
    assert abs(inside - 1) < 1e-3


def test_a_window_takes_its_exponentials_at_once_and_agrees_with_plain_formulas(monkeypatch):
    v = vocabulary()
    rng = np.random.default_rng(3)
    p = {k: x + 0.3 * rng.standard_normal(x.shape).astype(np.float32) for k, x in L.initial_parameters(v).items()}
    steps, lanes = 6, 40
    x, fresh = rng.integers(0, L.INPUTS, (steps, lanes)), rng.random((steps, lanes)) < 0.2
    start = rng.standard_normal((lanes, L.HIDDEN)).astype(np.float32) * np.float32(0.1)
    states = L.forward(p, x, fresh, start)[0].reshape(-1, L.HIDDEN)
    sigmoid, h, plain = lambda a: 1 / (1 + np.exp(-a)), start.astype(np.float64), []
    z, r, n = (slice(k * L.HIDDEN, (k + 1) * L.HIDDEN) for k in range(3))
    for t in range(steps):
        h = np.where(fresh[t][:, None], 0, h)
        e, u = p["input"][x[t]], p["state"]
        gate = sigmoid(e[:, z] + h @ u[:, z])
        h = (1 - gate) * h + gate * np.tanh(e[:, n] + (sigmoid(e[:, r] + h @ u[:, r]) * h) @ u[:, n])
        plain.append(h)
    assert np.allclose(states, np.concatenate(plain), atol=1e-5)
    slots = rng.integers(-1, 40, len(states))
    classes = np.where(slots >= 0, rng.integers(0, 6, len(states)), rng.integers(0, L.CLASSES + L.RARE, len(states)))
    softmax = lambda a: np.log(np.exp(a - a.max()) / np.exp(a - a.max()).sum())
    want = [softmax(s @ p["class_w"] + p["class_b"])[c] + (softmax(s @ p["word_w"][c] + p["word_b"][c])[k] if k >= 0 else 0) for s, c, k in zip(states, classes, slots)]
    calls, original = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **b: calls.append(1) or original(*a, **b))
    got = L.outputs(p, states, classes, slots, {})[0]
    assert np.allclose(got, want, atol=1e-4) and len(calls) == 2  # classes, and the slots of all of them


def test_state_is_carried_across_windows_and_lanes_do_not_matter():
    v = vocabulary()
    p = L.initial_parameters(v)
    rng = np.random.default_rng(2)
    lengths = np.array([1, 300, 5, 70, 33])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    keys = v.keys[rng.integers(0, len(v.keys), bounds[-1])]
    _, inputs, classes, slots = L._symbols(v, keys, bounds)
    one = L.log_likelihoods(p, inputs, classes, slots, bounds, 1)
    many = L.log_likelihoods(p, inputs, classes, slots, bounds, 5)
    assert np.allclose(one, many, atol=1e-4)
    alone = L.log_likelihoods(p, inputs[1:301], classes[1:301], slots[1:301], np.array([0, 300]), 1)
    assert np.allclose(alone, one[1:301], atol=1e-4)


def test_training_improves_held_out_likelihood(spark):
    rng = np.random.default_rng(5)
    speak = lambda a: " ".join(f"{a}{k}" for k in rng.integers(0, 40, 120))
    docs = [(k, speak("x" if k % 2 else "y")) for k in range(300)]
    got = L.score_documents(frame(spark, docs), F.col("doc_id") % 7 == 2, rounds=2).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got["s"] - got["b"]) / got["n"] > 0.15  # two languages, told apart: log10(2) = 0.3 at best


def test_registered_query_learns_from_every_training_row_once(spark, tmp_path, monkeypatch):
    docs = [(k, f"text number {k}") for k in range(300)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    seen, original = tmp_path / "seen", L._train_batches
    seen.mkdir()

    def spy(batches, model, rate):
        import uuid

        got = list(batches)
        (seen / uuid.uuid4().hex).write_text(f"{rate} {sum(len(b) for b in got)}")
        yield from original(iter(got), model, rate)

    monkeypatch.setattr(L, "_train_batches", spy)
    training = op1_lm_scoring(spark, str(tmp_path)).where("not held_out").count()
    by_round = Counter()
    for file in seen.iterdir():
        rate, n = file.read_text().split()
        by_round[rate] += int(n)
    assert 0 < training < len(docs) and len(by_round) == 2 and sum(by_round.values()) == training and min(by_round.values()) > training // 4
