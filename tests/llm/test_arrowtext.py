import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import arrowtext as A

from .corpus import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab \t\n\x0bÉ漢x")), max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_spans_are_the_words(texts):
    col = pa.array(texts, pa.string())
    got = []
    for _, _, buf, off in A.chunks(col, 16):
        s, e, b = A.spans(buf, off, A.IS_WORD)
        raw = buf.tobytes()
        got += [[raw[s[k] : e[k]].decode() for k in range(b[d], b[d + 1])] for d in range(len(off) - 1)]
    assert got == [words(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=120), min_size=1, max_size=10))
def test_xxh64_is_xxh64(parts):
    buf = np.frombuffer(b"".join(parts) + bytes(A.PAD), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = A.xxh64_spans(buf, ends - [len(p) for p in parts], ends, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_long_spans_and_slices():
    parts = [b"a" * 5000, b"a" * 5000, b"a" * 5001, b"b"]
    buf = np.frombuffer(b"".join(parts) + bytes(A.PAD), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    h = A.hash_spans(buf, starts, ends)
    assert h[0] == h[1] and len(set(h.tolist())) == 3
    assert int(A.xxh64_spans(buf, starts, ends, 42)[2]) == xxhash.xxh64_intdigest(parts[2], 42)
    sliced = pa.array(["zz", "a b", None, "c"]).slice(1)
    assert [len(off) - 1 for _, _, _, off in A.chunks(sliced)] == [3]


def test_windows_tell_contents_apart():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 3, 4000).astype(np.uint64)
    for size in (1, 2, 3, 5, 13, 35):
        w = A.windows(h, size)[: len(h) - size + 1]
        same = {}
        for k in range(len(w)):
            same.setdefault(tuple(h[k : k + size].tolist()), set()).add(int(w[k]))
        assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    rng.shuffle(keys)
    find = A.Lookup(keys)
    assert (find(keys) == np.arange(len(keys))).all()
    assert (find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (A.Lookup(keys[:0])(keys) == -1).all()
