"""Language-model scores of whole documents by a gated recurrent network.

Counts.  All training tokens are counted over the corpus.  Frequent words (a
table of bounded size) are broadcast; rarer ones meet their counts in a join.

Model.  A GRU in numpy reads a document token by token; its state is carried
across windows, so a score covers the complete document.  The output is factored:
a softmax over classes, then for the ``CLASSES * CLASS_SIZE`` most frequent words
a softmax inside the class.  All other words fall into classes by their last
letters and share their class's probability by add-one counts; words never seen
are one more type there.  Gradients are truncated at windows.

Training.  Every task trains on its own documents from a common start, and the
parameters are averaged, weighted by tokens, in a tree; this repeats in a few
rounds, and every training document is learned from in one of them.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .runtime import durable

CLASSES, CLASS_SIZE, RARE_BITS, HIDDEN = 45, 45, 5, 16
RARE = 1 << RARE_BITS
VOCAB = CLASSES * CLASS_SIZE
#: Input symbols: words of the output vocabulary, rare classes, start of a document.
INPUTS = VOCAB + RARE + 1
#: Words whose counts are broadcast, at most.
FREQUENT = 1 << 18
#: Steps of a window: gradients are cut there, states are not.
WINDOW = 32
LANES = 512
#: Text bytes whose documents run side by side.
BATCH_BYTES = 32 << 20
_TOP = np.uint64(64 - RARE_BITS)
END = np.uint64(0x00E4D0F7E87A11CE)
NO_ID = -(1 << 63)


def token_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of each document, an end after its words, and their ranges. A word's top bits are its class by its last letters."""
    low = A.LOWER[buf]
    starts, ends, bounds = A.spans(low, offsets, A.IS_WORD)
    h = A.hash_spans(low, starts, ends, 5)
    if len(starts):
        # the last three bytes, zeros before a shorter word
        tail = np.zeros(len(starts), np.uint64)
        for k in (3, 2, 1):
            inside = ends - k >= starts
            tail = tail * np.uint64(256) + np.where(inside, low[np.maximum(ends - k, 0)], 0).astype(np.uint64)
        h = ((A.mix(tail) >> _TOP) << _TOP) | (h >> np.uint64(RARE_BITS))
    n_docs = len(bounds) - 1
    out = np.empty(len(h) + n_docs, np.uint64)
    to = bounds + np.arange(n_docs + 1)
    is_end = np.zeros(len(out), bool)
    is_end[to[1:] - 1] = True
    out[is_end], out[~is_end] = END, h
    return out, to


# --- counts -----------------------------------------------------------------


def _count_batches(batches: Iterator[pa.RecordBatch], flush: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0

    def merged():
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

    for batch in batches:
        for _, _, buf, offsets in A.chunks(batch.column("text")):
            k, n = np.unique(token_keys(buf, offsets)[0], return_counts=True)
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > flush:
                k, n = merged()
                keys, counts, held = [k], [n], len(k)
                if held > flush // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])
                    keys, counts, held = [], [], 0
    if keys:
        k, n = merged()
        for at in range(0, len(k), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 17)].view(np.int64)), pa.array(n[at : at + (1 << 17)])], names=["key", "n"])


def token_counts(rows: DataFrame) -> DataFrame:
    """``(key, n)``: how often each token is in the column ``text``."""
    return rows.select("text").mapInArrow(_count_batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words with their counts, what the model needs of the rest, and totals."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rare_tokens: np.ndarray, rare_types: np.ndarray, tokens: int, types: int, complete: bool):
        self.keys, self.counts = keys, counts  # most frequent first; the first VOCAB have outputs of their own
        self.rare_norm = np.log10(rare_tokens + rare_types + 1.0)
        self.rare_tokens = rare_tokens
        self.tokens, self.types, self.complete = tokens, types, complete

    def open(self) -> "Vocabulary":
        self.lookup = A.Lookup(self.keys)
        self.log_counts = np.log10(self.counts + 1.0)
        return self


def build_vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """From the durable table of counts; what it collects is bounded by ``frequent`` words and a few hundred sums."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = sorted(((r["s"], r["words"]) for r in counts.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, held = None, 0
    for s, words in steps:
        if held + words > frequent:
            break
        least, held = s, held + words
    top = counts.where(size >= (least if least is not None else 1 << 30)).toArrow()
    keys, n = top["key"].to_numpy().view(np.uint64).copy(), top["n"].to_numpy().copy()
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    sums = counts.groupBy(F.shiftrightunsigned("key", 64 - RARE_BITS).alias("c")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).collect()
    tokens, types = np.zeros(RARE), np.zeros(RARE)
    for r in sums:
        tokens[r["c"]], types[r["c"]] = r["tokens"], r["types"]
    total, distinct = int(tokens.sum()), int(types.sum())
    # the end comes first among the words with outputs of their own
    found = np.flatnonzero(keys == END)
    ends = n[found] if len(found) else np.array([r["n"] for r in counts.where(F.col("key") == int(END.view(np.int64))).collect()] or [0])
    keys, n = np.r_[END, np.delete(keys, found)], np.r_[ends, np.delete(n, found)]
    own = keys[:VOCAB][n[:VOCAB] > 0]
    cls = (own >> _TOP).astype(np.int64)
    tokens -= np.bincount(cls, weights=n[: len(own)], minlength=RARE)
    types -= np.bincount(cls, minlength=RARE)
    return Vocabulary(keys, n, tokens, types, total, distinct, held >= distinct)


# --- the network --------------------------------------------------------------


def initial_parameters(vocabulary: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; biases that make the start a unigram model."""
    rng = np.random.default_rng(seed)
    own = np.zeros(VOCAB)
    m = min(VOCAB, len(vocabulary.counts))
    own[:m] = vocabulary.counts[:m]
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    bias = np.log(own.reshape(CLASSES, CLASS_SIZE) + 0.5)
    bias -= bias.max(axis=1, keepdims=True)
    bias.reshape(-1)[m:] = -1e9  # places without a word
    if m < VOCAB:
        empty = np.flatnonzero(np.arange(CLASSES) * CLASS_SIZE >= m)
        bias[empty] = 0.0
    mass = np.r_[own.reshape(CLASSES, CLASS_SIZE).sum(axis=1) + 0.01, vocabulary.rare_tokens + 1.0]
    return {
        "input": small(INPUTS, 3 * HIDDEN), "state": small(HIDDEN, 3 * HIDDEN), "class_w": small(HIDDEN, CLASSES + RARE), "class_b": np.log(mass / mass.sum()).astype(np.float32),
        "word_w": small(CLASSES, HIDDEN, CLASS_SIZE), "word_b": bias.astype(np.float32),
    }


def _gate_rows(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the input table by gate and symbol, and the state's matrices by gate; those of the two sigmoids halved, as their tanh wants it."""
    table, u = (np.ascontiguousarray(p[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) for k in ("input", "state"))
    table[:2] *= 0.5
    u[:2] *= 0.5
    return table.reshape(-1, HIDDEN), u


def forward(p: dict, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """States after each step of a window (steps x lanes); ``fresh`` marks steps that begin a document. Gates lie apart, so that every step works on whole arrays."""
    steps, lanes = inputs.shape
    table, u = _gate_rows(p)
    x = np.take(table, inputs[:, None, :] + np.arange(3, dtype=np.int32)[:, None] * np.int32(INPUTS), axis=0)
    kind = u.dtype
    zr, new = np.empty((steps, 2, lanes, HIDDEN), kind), np.empty((steps, lanes, HIDDEN), kind)
    states, prior, part = np.empty_like(new), np.empty_like(new), np.empty((lanes, HIDDEN), kind)
    any_fresh = fresh.any(axis=1)
    for t in range(steps):
        prior[t] = h
        h, g, n = prior[t], zr[t], new[t]
        if any_fresh[t]:
            h[fresh[t]] = 0
        np.matmul(h, u[:2], out=g)
        g += x[t, :2]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        np.multiply(g[1], h, out=part)
        np.matmul(part, u[2], out=n)
        n += x[t, 2]
        np.tanh(n, out=n)
        np.subtract(n, h, out=part)
        part *= g[0]
        h = np.add(h, part, out=states[t])
    return states, prior, (zr, new), h


def _exponentials(logits: np.ndarray, w: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place of the logits, and their sums by row. No row maximum is taken off: logits stay far below
    the limit of float32's exponential, and where ``w`` and states up to ``reach`` don't rule more out, they are cut there."""
    if (np.abs(w[:-1]).sum(axis=0) * reach + w[-1]).max() > 60:
        np.minimum(logits, 60, out=logits)
    e = np.exp(logits, out=logits)
    return e, e @ np.ones(e.shape[1], e.dtype)


def outputs(p: dict, states: np.ndarray, classes: np.ndarray, slots: np.ndarray, grads: dict | None = None):
    """Natural log probability of each token's class and of its slot there (-1: no slot); with ``grads`` also the gradient by the states.

    Biases are the last row of the weights, met by a column of ones. Gradients are scaled by the states' rows, which are shorter than those of the probabilities.
    """
    n = len(states)
    states = np.concatenate([states, np.ones((n, 1), states.dtype)], axis=1)
    reach = float(np.abs(states).max(initial=1))
    w = np.concatenate([p["class_w"], p["class_b"][None]])
    logits = states @ w
    picked = np.arange(n) * logits.shape[1] + classes
    logp = logits.ravel()[picked]
    e, total = _exponentials(logits, w, reach)
    logp -= np.log(total)
    back = None
    if grads is not None:
        e.ravel()[picked] -= total
        scale = (1 / total)[:, None]
        g = (states * scale).T @ e
        grads["class_w"], grads["class_b"] = g[:-1], g[-1]
        back = e @ p["class_w"].T
        back *= scale
    # tokens with a slot, by class: one product a class, all else over all of them
    group = np.where(slots >= 0, classes, CLASSES).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=CLASSES)[:CLASSES])]).tolist()
    order = order[: edge[-1]]
    s = states[order]
    w = np.concatenate([p["word_w"], p["word_b"][:, None]], axis=1)
    logits = np.empty((len(order), CLASS_SIZE), np.result_type(s, w))
    ranges = [(c, slice(edge[c], edge[c + 1])) for c in range(CLASSES) if edge[c] < edge[c + 1]]
    for c, at in ranges:
        np.matmul(s[at], w[c], out=logits[at])
    picked = np.arange(len(order)) * CLASS_SIZE + slots[order]
    inside = logits.ravel()[picked]
    e, total = _exponentials(logits, w.transpose(1, 0, 2).reshape(HIDDEN + 1, -1), reach)
    logp[order] += inside - np.log(total)
    if grads is not None:
        e.ravel()[picked] -= total
        scale = (1 / total)[:, None]
        s *= scale
        g, inner = np.zeros_like(w), np.empty((len(order), HIDDEN), back.dtype)
        for c, at in ranges:
            np.matmul(s[at].T, e[at], out=g[c])
            np.matmul(e[at], p["word_w"][c].T, out=inner[at])
        grads["word_w"], grads["word_b"] = g[:, :-1], g[:, -1]
        inner *= scale
        back[order] += inner
    return logp, back


def backward(p: dict, inputs, fresh, states, prior, gates, back, grads: dict) -> None:
    """Adds the gradients of the recurrent part, back to the window's first step."""
    steps, lanes = inputs.shape
    zr, n = gates
    z, r = np.ascontiguousarray(zr[:, 0]), np.ascontiguousarray(zr[:, 1])
    u = np.ascontiguousarray(p["state"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
    dx = np.empty((3, steps, lanes, HIDDEN), n.dtype)
    carry, part = np.zeros((lanes, HIDDEN), n.dtype), np.empty((lanes, HIDDEN), n.dtype)
    # what a state's gradient is multiplied by on its way to the gates and to the state before
    keep = 1 - z
    by_n = z * (1 - n * n)
    by_z = (n - prior) * z * keep
    by_r = prior * r * (1 - r)
    any_fresh = fresh.any(axis=1)
    for t in range(steps - 1, -1, -1):
        carry += back[t]
        np.multiply(carry, by_n[t], out=dx[2, t])
        np.matmul(dx[2, t], u[2], out=part)
        np.multiply(carry, by_z[t], out=dx[0, t])
        np.multiply(part, by_r[t], out=dx[1, t])
        carry *= keep[t]
        part *= r[t]
        carry += part
        carry += np.matmul(dx[0, t], u[0], out=part)
        carry += np.matmul(dx[1, t], u[1], out=part)
        if any_fresh[t]:
            carry[fresh[t]] = 0
    before, flat = prior.reshape(-1, HIDDEN), dx.reshape(3, -1, HIDDEN)
    grads["state"] = np.concatenate([before.T @ flat[0], before.T @ flat[1], (r * prior).reshape(-1, HIDDEN).T @ flat[2]], axis=1)
    grads["input"] = np.zeros_like(p["input"])
    symbols = inputs.ravel().astype(np.uint16)
    order = np.argsort(symbols, kind="stable")
    found = symbols[order]
    edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    for k in range(3):
        grads["input"][found[edge], k * HIDDEN : (k + 1) * HIDDEN] = np.add.reduceat(flat[k][order], edge, axis=0)


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, p: dict, grads: dict, scale: float, progress: float) -> None:
        self.t += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) * scale
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.rate * (1 - 0.8 * progress) * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            # running means m += 0.1 (g - m) and v += 0.01 (g g - v), without further arrays
            g = g * np.float32(scale)
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += g * np.float32(0.1)
            g *= g
            g *= 0.01
            v *= 0.99
            v += g
            np.sqrt(v, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= rate
            p[k] -= g


def deal(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of token places (steps x lanes, -1 beyond a lane's end), each document in one lane, longest lane first; and the lanes' lengths."""
    lanes = max(1, min(lanes, len(lengths)))
    first = np.concatenate([[0], np.cumsum(lengths)])
    heap = [(0, k) for k in range(lanes)]
    lists: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        lists[k].append(d)
        heapq.heappush(heap, (load + int(lengths[d]), k))
    loads = np.array([sum(int(lengths[d]) for d in docs) for docs in lists])
    order = np.argsort(-loads, kind="stable")
    table = np.full((int(loads.max()), lanes), -1, np.int64)
    for column, k in enumerate(order):
        at = 0
        for d in lists[k]:
            n = int(lengths[d])
            table[at : at + n, column] = np.arange(first[d], first[d] + n)
            at += n
    return table, loads[order]


def _symbols(vocabulary: Vocabulary, keys: np.ndarray, bounds: np.ndarray):
    """Places among frequent words, input symbols, classes and slots of tokens."""
    place = vocabulary.lookup(keys)
    own = (place >= 0) & (place < VOCAB)
    rare = (keys >> _TOP).astype(np.int64)
    symbol = np.where(own, place, VOCAB + rare)
    classes = np.where(own, place // CLASS_SIZE, CLASSES + rare)
    slots = np.where(own, place % CLASS_SIZE, -1)
    inputs = np.empty(len(keys), np.int64)  # what is read before a token: the one before it
    inputs[1:] = symbol[:-1]
    inputs[bounds[:-1]] = INPUTS - 1
    return place, inputs.astype(np.int32), classes.astype(np.int32), slots.astype(np.int32)


def log_likelihoods(p: dict, inputs, classes, slots, bounds, lanes: int = LANES) -> np.ndarray:
    """Natural log probability of every token, states carried over whole documents."""
    out = np.zeros(len(inputs), np.float64)
    table, loads = deal(np.diff(bounds), lanes)
    is_first = np.zeros(len(inputs), bool)
    is_first[bounds[:-1]] = True
    h = np.zeros((table.shape[1], HIDDEN), np.float32)
    for t in range(0, len(table), WINDOW):
        live = int(np.searchsorted(-loads, -t, side="left"))
        part = table[t : t + WINDOW, :live]
        safe = np.maximum(part, 0)
        states, _, _, h = forward(p, inputs[safe], is_first[safe], h[:live])
        at = part.ravel() >= 0
        where = part.ravel()[at]
        out[where] = outputs(p, states.reshape(-1, HIDDEN)[at], classes[where], slots[where])[0]
    return out


def train(p: dict, inputs, classes, slots, bounds, rate: float) -> int:
    """Truncated backpropagation over the documents, in place; the tokens it saw."""
    n = len(inputs)
    lanes = int(np.clip(n // (WINDOW * 200), 8, 256))
    table, loads = deal(np.diff(bounds), lanes)
    is_first = np.zeros(n, bool)
    is_first[bounds[:-1]] = True
    optimiser = Adam(p, rate)
    h = np.zeros((table.shape[1], HIDDEN), np.float32)
    for t in range(0, len(table), WINDOW):
        live = int(np.searchsorted(-loads, -t, side="left"))
        part = table[t : t + WINDOW, :live]
        safe = np.maximum(part, 0)
        x, fresh = inputs[safe], is_first[safe]
        states, prior, gates, h = forward(p, x, fresh, h[:live])
        at = np.flatnonzero(part.ravel() >= 0)
        where = part.ravel()[at]
        grads: dict = {}
        _, d = outputs(p, states.reshape(-1, HIDDEN)[at], classes[where], slots[where], grads)
        back = np.zeros((part.size, HIDDEN), np.float32)
        back[at] = d
        backward(p, x, fresh, states, prior, gates, back.reshape(*part.shape, HIDDEN), grads)
        optimiser.step(p, grads, 1.0 / len(at), t / len(table))
    return n


# --- Spark ----------------------------------------------------------------------


def _train_batches(batches: Iterator[pa.RecordBatch], model, rate: float) -> Iterator[pa.RecordBatch]:
    vocabulary, start = pickle.loads(model.value)
    vocabulary.open()
    total, weight = None, 0
    for batch in batches:
        for _, _, buf, offsets in A.chunks(batch.column("text"), BATCH_BYTES):
            keys, bounds = token_keys(buf, offsets)
            p = {k: x.copy() for k, x in start.items()}
            n = train(p, *_symbols(vocabulary, keys, bounds)[1:], bounds, rate)
            total = {k: x * np.float64(n) if total is None else total[k] + x * np.float64(n) for k, x in p.items()}
            weight += n
    if weight:
        blob = pickle.dumps({k: (x / weight).astype(np.float32) for k, x in total.items()})
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([blob], pa.binary())], names=["weight", "blob"])


def _average(table: pa.Table) -> pa.Table:
    weights, total = table["weight"].to_pylist(), None
    for w, blob in zip(weights, table["blob"]):
        p = pickle.loads(blob.as_py())
        total = {k: x * np.float64(w) if total is None else total[k] + x * np.float64(w) for k, x in p.items()}
    n = sum(weights)
    return pa.table({"weight": pa.array([n], pa.int64()), "blob": pa.array([pickle.dumps({k: (x / n).astype(np.float32) for k, x in total.items()})], pa.binary())})


def fit_model(training: DataFrame, vocabulary: Vocabulary, rounds: int = 2, rate: float = 0.02, fan_in: int = 32) -> dict[str, np.ndarray]:
    """Parameters after one pass over all training texts, dealt by hash to ``rounds`` rounds of local training and averaging."""
    spark = training.sparkSession
    p = initial_parameters(vocabulary)
    turn = F.pmod(F.xxhash64("id", "text", F.lit(3)), F.lit(rounds))
    for k in range(rounds):
        model = spark.sparkContext.broadcast(pickle.dumps((vocabulary, p)))
        rows = training.where(turn == k).select("text")
        found = durable(rows.mapInArrow(partial(_train_batches, model=model, rate=rate / (k + 1)), "weight long, blob binary"))
        n = found.count()
        while n > fan_in:
            groups = -(-n // fan_in)
            found = durable(found.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("g")).applyInArrow(_average, "weight long, blob binary"))
            n = found.count()
        if n:
            p = pickle.loads(_average(found.toArrow())["blob"][0].as_py())
    return p


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    vocabulary, p = pickle.loads(model.value)
    vocabulary.open()
    log_types = np.log10(vocabulary.tokens + vocabulary.types + 1.0)
    for batch in batches:
        for lo, hi, buf, offsets in A.chunks(batch.column("text"), BATCH_BYTES):
            keys, bounds = token_keys(buf, offsets)
            place, inputs, classes, slots = _symbols(vocabulary, keys, bounds)
            doc = A.doc_of(bounds)
            logp = log_likelihoods(p, inputs, classes, slots, bounds) / np.log(10)
            known = place >= 0
            counted = np.where(known, vocabulary.log_counts[np.maximum(place, 0)], 0.0)  # the others' are added by the join
            rare = classes >= CLASSES
            score = logp + np.where(rare, counted - vocabulary.rare_norm[np.maximum(classes - CLASSES, 0)], 0.0)
            seen = known & (vocabulary.counts[np.maximum(place, 0)] > 0)
            sums = lambda x: np.bincount(doc, weights=x, minlength=hi - lo)
            n = np.diff(bounds)
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("print"), rows.column("held_out"), pa.array(n), pa.array(sums(seen).astype(np.int64)), pa.array(sums(counted) - n * log_types), pa.array(sums(score))],
                names=["id", "print", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def _rare_batches(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    lookup = A.Lookup(frequent.value)
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("print", pa.int64()), ("times", pa.int32())])

    def kernel(rows, buf, offsets):
        keys, bounds = token_keys(buf, offsets)
        at = np.flatnonzero(lookup(keys) < 0)
        key, doc = keys[at], A.doc_of(bounds)[at]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else at
        times = np.diff(np.r_[new, len(key)])
        d = doc[new]
        return {"key": key[new].view(np.int64), "id": rows.column("id").to_numpy()[d], "print": rows.column("print").to_numpy()[d], "times": times.astype(np.int32)}

    return A.map_chunks(batches, "text", kernel, schema)


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, rounds: int = 2) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row, log10.

    Tokens are runs of non-white-space with A-Z lower-cased, then one end; a null
    or empty text has the end alone.  ``held_out`` rows are scored but nothing is
    learned from them.  A null id is kept; repeated rows count twice in training
    and are scored alike.  Without training rows the base is one type unseen and
    the network stays as it began.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    keyed = rows.withColumn("print", F.xxhash64("text"))
    training = rows.where(~F.col("held_out"))
    counts = durable(token_counts(training))
    vocabulary = build_vocabulary(counts, frequent)
    p = fit_model(training, vocabulary, rounds)
    model = spark.sparkContext.broadcast(pickle.dumps((vocabulary, p)))
    scored = keyed.select("id", "print", "held_out", "text").mapInArrow(partial(_score_batches, model=model), "id long, print long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    firsts = [F.first(c).alias(c) for c in ("held_out", "n_tokens", "n_known", "base_score", "score")]
    per_text = scored.groupBy("id", "print").agg(*firsts, F.count(F.lit(1)).alias("copies"))
    if not vocabulary.complete:
        keys = spark.sparkContext.broadcast(vocabulary.keys)
        uses = keyed.select("id", "print", "text").mapInArrow(partial(_rare_batches, frequent=keys), "key long, id long, print long, times int")
        met = uses.join(counts, "key").groupBy("id", "print").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("known"))
        per_text = per_text.join(met, ["id", "print"], "left").select(
            "id", "held_out", "n_tokens", "copies", (F.col("n_known") + F.coalesce(F.col("known") / F.col("copies"), F.lit(0)).cast("long")).alias("n_known"),
            *[(F.col(c) + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))).alias(c) for c in ("base_score", "score")],
        )
    return per_text.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
