import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import collocations as C

from .corpus import LOWER, awkward, prose

SCHEMA = "doc_id long, text string, lang string, n long, word string, phrase string"


def frame(spark, docs, partitions=3):
    return spark.createDataFrame([(i, t, lang, 1, "w", "p") for i, t, lang in docs], SCHEMA).repartition(partitions)


def phrase_counts(docs, max_n=5):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + n]) for i in range(len(words)) for n in range(1, max_n + 1) if i + n <= len(words))
    return counts, totals


def plain(docs, least, top):
    counts, totals = phrase_counts(docs)
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * f[p[i:j]]}
        rows = []
        for p, a in frequent.items():
            if p not in inside:
                score, _, le, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), le, r))
        out += [(lang, k, text.decode(), -a, le, r, totals[lang], -score) for k, (score, a, text, le, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def spark_rows(spark, docs, least=3, top=40, **kw):
    return sorted(map(tuple, C.collocations(frame(spark, docs), min_count=least, top=top, **kw).collect()))


def corpus(seed=2):
    rng = random.Random(seed)
    docs = [(i, t, rng.choice(["en", "de", None, "und", ""])) for i, t in awkward()]
    docs += [(500 + k, prose(rng, 300, 60) + ", " + "of the " * 40 + prose(rng, 20) + ".\tOf\x00the\x01end é\x02x; 漢字 😀", "en") for k in range(6)]
    docs += [(600, "tie one, tie one, tie one, tie two, tie two, tie two\x0bA B. a b! A b? a, b", "xx"), (601, "L" * 3000 + " long " + "L" * 3000 + " long " + "L" * 3000 + " long", "xx")]
    return docs


@pytest.mark.parametrize("dictionary", [C.DICTIONARY_WORDS, 20, 0])
def test_against_plain_python_with_any_share_of_words_in_the_dictionary(spark, dictionary):
    docs = corpus()
    assert spark_rows(spark, docs, dictionary_words=dictionary) == plain(docs, 3, 40)


def test_all_frequent_phrases_with_many_tasks(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(C, "parallelism", lambda _: 40)  # prefixes then go on over several tasks
    monkeypatch.setattr(C, "SLICE_BYTES", 500)
    texts = frame(spark, docs, 5).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, totals = phrase_counts(docs)
    want = {(lang, " ".join(p), len(p), a) for lang, f in counts.items() for p, a in f.items() if a >= 4}
    for dictionary in (1000, 15):
        n, found = C.frequent_phrases(texts, 4, 5, dictionary)
        assert {tuple(r) for r in found.collect()} == want
        assert {tuple(r) for r in n.collect()} == set(totals.items())


def test_prefixes_go_on_over_batches():
    known = {"words": {"en": pa.array([b"a", b"b", b"c"], pa.large_binary())}, "bounds": [], "complete": True}
    rng = np.random.default_rng(1)
    table = np.array(sorted({tuple(r) for r in rng.integers(0, 3, (60, 3)).tolist()} | {(0, -1, -1), (1, 2, -1)}, reverse=True))
    n = rng.integers(1, 5, len(table))
    keys = C._encoded("en", table, pa.array([], pa.large_binary()))
    want = Counter()
    for row, k in zip(table.tolist(), n.tolist()):
        row = [w for w in row if w >= 0]
        for d in range(1, len(row) + 1):
            want[" ".join("abc"[w] for w in row[:d])] += k
    for size in (1, 2, 7, 100):
        stack = C.Stack(known, 3, 1)
        for k in range(0, len(table), size):
            stack.read(keys[k : k + size], n[k : k + size])
        stack.close()
        got = {x[1]: x[3] for x in stack.out}
        assert len(got) == len(stack.out) and got == want


def test_spelled_words_never_leave_the_order_of_tasks():
    rng = random.Random(4)
    distinct = pa.array([bytes(rng.choice(b"ab\x01\xc3") for _ in range(rng.randrange(1, 12))) for _ in range(80)], pa.large_binary())
    one = lambda: C._SPELLED + rng.randrange(80) if rng.random() < 0.4 else rng.choice([0, 1, 5])
    table = np.array([([one() for _ in range(rng.randrange(1, 6))] + [-1] * 5)[:5] for _ in range(400)])
    keys = C._encoded("x", table, distinct).to_pylist()
    dealt = list(zip(*(a.tolist() for a in C._deal_keys(table, distinct))))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    assert [dealt[k] for k in order] == sorted(dealt)
    bounds = sorted(set(dealt))[::17]
    part = C._parts(table, distinct, (3, [b[0] for b in bounds], [b[1] for b in bounds]))
    assert part.tolist() == [3 + sum(b <= d for b in bounds) for d in dealt]


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT cast(9000000000000 AS long) AS a, cast(20000000000000 AS long) AS n, cast(9000000000001 AS long) AS l, cast(9000000000007 AS long) AS r")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    up = (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    got = row.withColumn("_up", up).withColumn("_down", wide("l") * wide("r")).selectExpr("_up div _down AS s").first()["s"]
    assert got == 1000 * 9000000000000 * 20000000000000 // (9000000000001 * 9000000000007)


def test_an_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
