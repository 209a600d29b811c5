import numpy as np
import pytest

from tallyspark.llm.linededup import LineShard, PerfectHash, _build_shard, line_dedup

from .corpus import LOWER, awkward, empty, frame

STRIP = "\x20\t\n\x0b\x0c\r"


def expected(docs, min_docs=5):
    rows = [(t or "").split("\n") for _, t in docs]
    key = lambda line: line.strip(STRIP).translate(LOWER)
    seen = {}
    for (i, _), lines in zip(docs, rows):
        for k in {key(x) for x in lines if len(key(x)) >= 40}:
            seen.setdefault(k, []).append(-1 if i is None else i)
    out = []
    for (i, _), lines in zip(docs, rows):
        keep = [x for x in lines if not (len(seen.get(key(x), [])) >= min_docs and max(seen[key(x)]) != (-1 if i is None else i))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "probes_per_task": 3}])
def test_against_brute_force(spark, options):
    docs = awkward()
    df = frame(spark, docs)
    got = line_dedup(df, **options)
    assert set(got.columns) == {"doc_id", "text", "id", "rest", "kept", "n_lines", "n_dropped"}
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == expected(docs)
    assert {(r["id"], r["rest"], r["kept"]) for r in got.collect()} == {("x", 1.5, True)}


def test_low_threshold_drops_lines_of_copies(spark):
    docs = awkward()
    got = line_dedup(frame(spark, docs), min_docs=2, broadcast_limit=0)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == expected(docs, 2)


def test_empty_table(spark):
    assert line_dedup(empty(spark)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64))
    h = PerfectHash(keys)
    assert h.size == len(keys) and sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash(keys[:0]).index(keys).max() == -1


def test_colliding_first_hashes_keep_both_lines():
    import pickle

    import pyarrow as pa

    t = pa.table({"h1": [7, 7, 9], "h2": [1, 2, 3], "n": [5, 6, 7], "keeper": [10, 20, 30], "shard": [0, 0, 0]})
    arrays = pickle.loads(_build_shard(t)["blob"][0].as_py())
    assert len(arrays) == 2 and all(isinstance(a, LineShard) for a in arrays)
    hit = np.zeros(3, bool)
    for a in arrays:
        hit |= a.probe(np.array([7, 7, 9], np.uint64), np.array([1, 2, 8], np.uint64), np.array([1, 20, 1]), 5)
    assert hit.tolist() == [True, False, False]
