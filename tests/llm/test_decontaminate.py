import random
import re

import pytest

from tallyspark.llm.decontaminate import contamination, decontaminate

from .corpus import LOWER, awkward, empty, frame, prose

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def expected(docs, items):
    wins = {}
    for k, t in items:
        w = words(t)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if k is None else str(k))
    sizes = {len(x) for x in wins}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[g]
        out.append((i, len(w), sorted(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(9)
    docs = awkward()
    items = [(k, prose(rng, rng.choice([13, 14, 30, 60]))) for k in range(20)] + [(100, "one"), (101, "Two words"), (102, None), (103, "..."), (None, prose(rng, 20)), (104, "Dup Item here"), (105, "dup item HERE")]
    docs += [(200 + k, prose(rng, 30) + " " + (t or "").upper().replace(" ", ", ") + " " + prose(rng, rng.choice([3, 900]))) for k, (_, t) in enumerate(items)]
    docs += [(300, " ".join(prose(rng, 5) for _ in range(900)) + " " + items[0][1]), (301, "xx dup item here yy one")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500}])
def test_against_brute_force(spark, options):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, docs), bench, **options).collect()
    assert sorted(((r["id"], r["n_words"], r["hit_words"], r["items"], r["contaminated"]) for r in got), key=str) == expected(docs, items)


def test_filter_and_empty_tables(spark):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    out = decontaminate(df, bench)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((e[0] for e in expected(docs, items) if not e[-1]), key=str)
    assert decontaminate(empty(spark), bench).count() == 0
    assert decontaminate(df, bench.limit(0)).count() == len(docs)
