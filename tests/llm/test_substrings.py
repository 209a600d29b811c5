import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import arrowtext as A
from tallyspark.llm.runtime import durable_alone
from tallyspark.llm.substrings import designate, recompress, remove_repeats

from .corpus import awkward, empty, frame, prose, words


def expected(docs, size):
    seen = {}
    texts = [words(t) for _, t in docs]
    for d, w in enumerate(texts):
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((d, i))
    gone = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + size))
    return sorted(((i, " ".join(x for k, x in enumerate(w) if k not in g), len(w), len(g)) for (i, _), w, g in zip(docs, texts, gone)), key=str)


@pytest.mark.parametrize("size", [35, 8, 1])
def test_against_brute_force(spark, size):
    docs = awkward()
    got = remove_repeats(frame(spark, docs), window=size).collect()
    assert sorted(((r["id"], r["text"], r["n_words"], r["n_removed"]) for r in got), key=str) == expected(docs, size)


def test_runs_periods_and_small_alphabets(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(30, 120)))) for k in range(40)]
    docs += [(100, "ab " * 60), (101, "ab " * 34), (102, "a b c " * 30), (103, "b c a " * 20), (104, prose(rng, 50) + " ab" * 40), (105, " ".join(f"u{k}" for k in range(300)))]
    got = remove_repeats(frame(spark, docs), window=12).collect()
    assert sorted(((r["id"], r["text"], r["n_words"], r["n_removed"]) for r in got), key=str) == expected(docs, 12)


def colliding_words(rng, n):
    """Pairs of words of 16 bytes with one hash: the last eight bytes make up for the first eight."""
    m1 = int(A._M1)
    head = lambda lane: A.mix(np.full(len(lane), A.mix(np.array([16 * m1 & (1 << 64) - 1], np.uint64))[0]) ^ lane * A._M1)
    pairs = []
    while len(pairs) < n:
        one = rng.integers(97, 123, 16).astype(np.uint8).tobytes()
        a1, a2 = (np.frombuffer(one[k : k + 8], "<u8") for k in (0, 8))
        b1 = rng.integers(33, 127, (200_000, 8)).astype(np.uint8).view("<u8").ravel()
        b2 = (head(a1) ^ head(b1) ^ (a2 * A._M1)) * np.uint64(pow(m1, -1, 1 << 64))
        plain = b2.view(np.uint8).reshape(-1, 8)
        for k in np.flatnonzero(((plain > 32) & (plain < 127)).all(axis=1))[:1]:
            pairs.append((one.decode(), (b1[k].tobytes() + b2[k].tobytes()).decode()))
    return pairs


def test_words_whose_hashes_collide_are_other_words(spark):
    rng = np.random.default_rng(8)
    pairs = colliding_words(rng, 6)
    buf = np.frombuffer("".join(a + b for a, b in pairs).encode() + b"\0" * A.PAD, np.uint8)
    at = np.arange(0, 16 * 12, 16)
    h = A.hash_spans(buf, at, at + 16)
    assert (h[0::2] == h[1::2]).all()
    base = [f"w{k}" for k in range(70)]
    docs = [(1, " ".join(base[:20] + ["abcdefghijklmnop"] + base[20:34])), (2, " ".join(base[:20] + ['rzctyojkB"P;pk1W'] + base[20:34]))]
    for k, (a, b) in enumerate(pairs):
        rest = [f"x{k}_{i}" for i in range(80)]
        docs += [(10 + 10 * k, " ".join([*rest[:40], a, *rest[40:]])), (11 + 10 * k, " ".join([*rest[:40], b, *rest[40:]])), (12 + 10 * k, " ".join([*rest[10:40], a, *rest[40:60]]))]
    docs += [(200 + k, " ".join(a if (j >> k) & 1 else b for j, (a, b) in enumerate(pairs * 9))) for k in range(4)]
    got = remove_repeats(frame(spark, docs)).collect()
    want = expected(docs, 35)
    assert sorted(((r["id"], r["text"], r["n_words"], r["n_removed"]) for r in got), key=str) == want
    assert {w[0]: w[3] for w in want}[1] == 0 and max(w[3] for w in want) > 35


def test_empty_table(spark):
    assert remove_repeats(empty(spark)).count() == 0


def test_equal_windows_are_known_by_equal_symbols():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 30, 80)
    texts = [np.r_[rng.integers(0, 30, rng.integers(0, 60)), passage, rng.integers(0, 30, rng.integers(0, 60))] for _ in range(30)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words_ = A.mix(np.concatenate(texts).astype(np.uint64))
    sym, doc, lo, hi = recompress(words_, bounds, 6)
    by = designate(sym, doc, lo, hi, bounds, 35)
    fits = A.window_mask(bounds, 35)
    names = {}
    for i in np.flatnonzero(fits):
        key = tuple(words_[i : i + 35].tolist())
        names.setdefault(key, set()).add((int(sym[by[i]]), int(lo[by[i]] - i)) if by[i] >= 0 else None)
    assert all(len(v) == 1 for v in names.values())
    owned = by[fits & (by >= 0)]
    assert len(owned) > 0.5 * fits.sum()


def test_shuffles_go_and_rows_stay(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    kept = durable_alone(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(name) == before
    for _ in range(2):  # read from the shared folder, again and again
        assert sorted(map(tuple, kept.collect())) == [(k, len(range(k, 1000, 7))) for k in range(7)]
