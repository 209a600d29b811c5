import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm.tokencounts import count_tokens, margin_of, word_starts

from .corpus import awkward, empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(docs, library=LIBRARY):
    return sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs), key=str)


def spark_rows(spark, docs, path=PATH, **kw):
    return sorted(map(tuple, count_tokens(frame(spark, docs), path, **kw).collect()), key=str)


def noisy(rng, n):
    """Text of all that splitting looks at: runs of spaces, contractions, digits, signs, other scripts, special strings."""
    bits = ["word", " the", "  ", "\n\n", " ", "'s", "'re", "'", "12345", " 9", "!?", "é", "漢字", "😀", "<|endoftext|>", "<|endof", "text|>", "\t", " ", "a", "ing", "#"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_awkward_texts_whole(spark):
    assert spark_rows(spark, awkward()) == plain(awkward())


@pytest.mark.parametrize(("chunk", "overlap"), [(100, 64), (137, 80), (4096, 256)])
def test_chunks_give_the_count_of_the_whole_text(spark, chunk, overlap):
    rng = random.Random(chunk)
    docs = awkward() + [(200 + k, noisy(rng, rng.randrange(50, 3000))) for k in range(30)]
    docs += [(300, "x" * 20_000), (301, " " * 9000 + "end"), (302, "漢" * 5000), (303, "<|endoftext|>" * 300), (304, "a b" * 3000 + "y" * 3000 + " c" * 2000), (304, "a b" * 3000 + "y" * 3000 + " c" * 2000)]
    assert spark_rows(spark, docs, chunk_chars=chunk, overlap_chars=overlap) == plain(docs)


def test_a_word_longer_than_the_overlap_widens_it(spark):
    docs = [(1, "some words " * 50 + "z" * 700 + " and more words" * 50)]
    assert spark_rows(spark, docs, chunk_chars=128, overlap_chars=64) == plain(docs)


def test_splices_are_where_the_whole_text_begins_words():
    rng = random.Random(5)
    margin = margin_of(PATH)
    for _ in range(150):
        text = noisy(rng, 300)
        whole = dict(zip(*(x.tolist() for x in word_starts(PATH, text)[:2])))
        cut = rng.randrange(10, len(text) - 10)
        end = min(len(text), cut + 150)
        before, after = word_starts(PATH, text[:end]), word_starts(PATH, text[cut:])
        common = ({a for a in before[0].tolist() if cut <= a <= end - margin}) & {a + cut for a in after[0].tolist()}
        assert common <= set(whole)
        total = word_starts(PATH, text)[2]
        left, right = dict(zip(before[0].tolist(), before[1].tolist())), {a + cut: r for a, r in zip(after[0].tolist(), after[1].tolist())}
        assert all(left[p] + after[2] - right[p] == total for p in common)


def test_tokenizers_without_proven_splices_encode_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert margin_of(path) is None
    docs = [(1, "Some WORDS here " * 400), (2, None)]
    assert spark_rows(spark, docs, path, chunk_chars=64, overlap_chars=64) == plain(docs, Tokenizer.from_file(path))
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    assert spark_rows(spark, docs, path) == [(i, len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for i, t in docs]


def test_an_empty_table(spark):
    assert count_tokens(empty(spark), PATH).collect() == []
