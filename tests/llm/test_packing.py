import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.packing import _split_last, choose_cuts, load_encoder, pack_documents
from tallyspark.llm.queries import tokenizer_path

from .corpus import awkward, empty, frame


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_round_trip(spark, reference):
    docs = awkward() + [(400, "special <|endoftext|> string"), (401, " " * 3000 + "x" * 3000)]
    rows = pack_documents(frame(spark, docs), tokenizer_path()).collect()
    want = sorted([(i, tuple(reference.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in docs], key=str)
    by_id = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        by_id.setdefault(r["id"], []).append(r)
    got = []
    for i, pieces in by_id.items():
        # repeated rows lie in sequences of their own order
        pieces.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        ids = []
        for r in pieces:
            assert r["start"] == len(ids)
            ids += r["ids"]
            if len(ids) == r["doc_tokens"]:
                got.append((i, tuple(ids)))
                ids = []
        assert not ids
    assert sorted(got, key=str) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_fast_and_slow_encoders_agree(reference):
    encode, ends = load_encoder(tokenizer_path())
    for _, t in awkward():
        assert encode(t or "").tolist() == reference.encode(t or "", add_special_tokens=False).ids
    assert ends[reference.encode("End.", add_special_tokens=False).ids[-1]] and not ends[reference.encode("word", add_special_tokens=False).ids[-1]]


def test_empty_table(spark):
    assert pack_documents(empty(spark), tokenizer_path()).count() == 0


def best_cost(ends, soft, length, sentence, hard):
    """Least padding plus penalties over all cuts at places, every transition tried: one window, or a full one cut wherever it ends and another."""
    places = {0, *ends, *soft}
    base = sorted(places)
    for a, b in zip(base, base[1:]):
        if b - a > length:
            places |= {p + k * length for p in base if a - length < p <= a for k in range(1, b // length + 2) if a < p + k * length < b}
    cost = {p: 0 if p in ends else sentence if p in soft else hard for p in places}
    best = {0: 0.0}
    for j in sorted(places)[1:]:
        best[j] = cost[j] + min(best[i] + hard * k + length * (k + 1) - (j - i) for i in best for k in range(2) if length * k < j - i <= length * (k + 1))
    return best[max(places)]


def paid(cuts, ends, soft, length, sentence, hard):
    cost = lambda p: 0 if p in ends else sentence if p in soft else hard
    return sum(length - (b - a) + cost(b) for a, b in zip(cuts, cuts[1:]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=9), st.sets(st.integers(0, 300), max_size=30))
def test_cuts_are_the_best_of_all_transitions(sizes, marks):
    ends = np.cumsum(sizes)
    length = 32
    soft = [m for m in sorted(marks) if 0 < m < ends[-1]]
    for hard in (1, 9, 40):
        cuts = choose_cuts(ends, np.array(soft, np.int64), length, 0.5, hard).tolist()
        assert cuts[0] == 0 and cuts[-1] == ends[-1] and max(np.diff(cuts)) <= length and min(np.diff(cuts)) > 0
        assert abs(paid(cuts, set(ends.tolist()), set(soft), length, 0.5, hard) - best_cost(set(ends.tolist()), set(soft), length, 0.5, hard)) < 1e-9


def test_every_sentence_end_is_offered_and_sentences_stay_whole_where_that_costs_little():
    ends, soft = np.array([4000]), np.arange(10, 4000, 10)
    cuts = choose_cuts(ends, soft, 1024).tolist()
    assert cuts == [0, 1020, 2040, 3060, 4000]  # ends of sentences, at four padded tokens each
    one = choose_cuts(np.array([5000]), np.array([300]), 1024).tolist()  # no boundary for several windows
    assert one[-1] == 5000 and max(np.diff(one)) <= 1024 and len(one) == 6


def test_last_window_in_powers_of_two():
    assert _split_last(np.array([0, 1024, 1724]), 1024, 64).tolist() == [0, 1024, 1536, 1664, 1696, 1712, 1720, 1724]
    assert _split_last(np.array([0, 1000]), 1024, 64).tolist() == [0, 1000]
