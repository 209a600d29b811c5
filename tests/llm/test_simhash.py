import random

import numpy as np
import pyarrow as pa
import xxhash

from tallyspark.llm.simhash import drop_near_duplicates, hamming_edges, near_duplicates, trie_forest

from .corpus import LOWER, awkward, empty, frame, prose, words


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def expected(docs):
    fps = [fingerprint(t) for _, t in docs]
    comp = components(fps)
    least = {}
    for (i, _), c in zip(docs, comp):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted(((i, f, least[c]) for (i, _), f, c in zip(docs, fps, comp)), key=str)


def test_against_brute_force(spark):
    docs = awkward()
    for cap in (200_000, 3):
        got = near_duplicates(frame(spark, docs), shard_cap=cap).collect()
        assert sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=str) == expected(docs)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert drop_near_duplicates(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = awkward()
    out = drop_near_duplicates(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    want = {c for _, _, c in expected(docs)}
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(want, key=str)


def test_unlike_texts_stay_whatever_their_ids(spark):
    rng = random.Random(7)
    a, b, c, d, e = (prose(rng, 60, 5000) for _ in range(5))
    docs = [(None, a), (None, b), (None, b), (5, c), (5, d), (9, e), (1, e), (9, prose(rng, 60, 5000))]
    got = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(frame(spark, docs)).collect()), key=str)
    assert got == sorted([docs[0], docs[1], docs[3], docs[4], docs[6], docs[7]], key=str)
    # an id is kept once, and its other row is a copy of a row with a smaller id
    got = [(r["doc_id"], r["text"]) for r in drop_near_duplicates(frame(spark, docs[5:])).collect()]
    assert sorted(got) == sorted(docs[6:])


def forest_by_pairs(fps, bits=3):
    """``components`` for larger groups: all pairs by numpy rows, then union-find."""
    f = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= bits).tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def around(rng, n, spread, rate=0.4):
    center = rng.getrandbits(64)
    bits = rng.sample(range(64), spread)
    return sorted({center ^ sum(1 << b for b in bits if rng.random() < rate) for _ in range(n)})


def test_trie_join_in_dense_and_sparse_groups():
    rng = random.Random(2)
    for n, spread, rate in ((300, 6, 0.4), (500, 14, 0.4), (400, 64, 0.4), (6000, 30, 0.12), (4500, 64, 0.05)):
        fps = around(rng, n, spread, rate)
        got = trie_forest(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), 3)
        assert got.tolist() == forest_by_pairs(fps)
    assert len(fps) > 2000  # the last groups are walked at one bit first
    two = trie_forest(np.array([0, 1]), np.array([5, 5], np.uint64), 3)
    assert two.tolist() == [0, 1]


def test_small_groups_are_walked_down_the_trie(monkeypatch):
    """Pairs are only compared where both nodes hold one fingerprint, whatever the group's size."""
    from tallyspark.llm import simhash

    rng = random.Random(4)
    fps = around(rng, 12, 64)
    asked = []
    plain = simhash._merge
    monkeypatch.setattr(simhash, "_merge", lambda label, i, j: (asked.append((i, j)), plain(label, i, j)))
    trie_forest(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), 3)
    assert sum(len(i) for i, _ in asked) == 0  # random fingerprints: every pair is pruned or fails at its leaves
    assert trie_forest(np.zeros(2, np.int64), np.array([0, 7], np.uint64), 3).tolist() == [0, 0]


def test_shards_across_batches_and_slices(monkeypatch):
    from tallyspark.llm import simhash

    rng = random.Random(6)
    rows = sorted((shard, fp) for shard in range(9) for fp in around(rng, 70, 12))
    rows = [r for r in rows for _ in range(2)]  # repeated rows of a shard count once
    key, fp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)
    monkeypatch.setattr(simhash, "SLICE", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 17]), pa.array(fp[k : k + 17].view(np.int64))], names=["shard", "fp"]) for k in range(0, len(rows), 17)]
    edges = [(a, b) for out in simhash._forest_batches(iter(batches), 3) for a, b in zip(out.column(0).to_numpy().view(np.uint64).tolist(), out.column(1).to_numpy().view(np.uint64).tolist())]
    want = 0
    for shard in range(9):
        own = sorted({f for s, f in rows if s == shard})
        want += len(own) - len(set(components(own)))
    assert len(edges) == want and all(bin(a ^ b).count("1") <= 64 for a, b in edges)


def test_more_bits_against_brute_force(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [x ^ sum(1 << 8 * k + rng.randrange(8) for k in range(8)) for x in fps[:10]]  # a bit of each byte
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    root = list(range(len(fps)))
    for r in hamming_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), 8).collect():
        a, b = sorted((root[signed.index(r["a"])], root[signed.index(r["b"])]))
        root = [a if x == b else x for x in root]
    assert root == components(fps, 8)
