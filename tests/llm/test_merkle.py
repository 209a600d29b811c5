import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.merkle import fold, merkle_manifest, siblings

from .corpus import awkward, empty, frame

SCHEMA = "doc_id long, text string, source string, idx long, node string, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """Per node its siblings from the bottom up as (before, after), and what remains."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
            paths[k].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        where = [at // 3 for at in where]
    return paths, nodes[0]


def plain(docs, altered):
    """Rows (id, leaf, altered leaf, subroot, root, proof, folded) in plain Python."""
    groups = {}
    for i, text, source in docs:
        leaf = h(written(i), written(source), written(text))
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf, i, h(written(i), written(source), written(altered(i, text)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: climb([x[1] for x in sorted(groups[s])]) for s in names}
    above, root = climb([below[s][1] for s in names])
    out = []
    for place, s in enumerate(names):
        for (_, leaf, i, other), path in zip(sorted(groups[s]), below[s][0]):
            whole, node = path + above[place], other
            for before, after in whole:
                node = h(before, node, after)
            out.append((i, leaf, other, below[s][1], root, h("".join(a + b for a, b in whole)), node))
    return sorted(out, key=str)


def spark_rows(spark, docs, partitions=3):
    df = spark.createDataFrame([(i, t, s, 7, "x", "y") for i, t, s in docs], SCHEMA).repartition(partitions)
    tampered = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle_manifest(df, ["doc_id", "source", "text"], altered={"text": tampered})
    told = made.select("id", "leaf", "altered_leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256), fold(F.col("altered_leaf"), F.col("path")))
    return sorted(map(tuple, told.collect()), key=str)


def tamper(i, text):
    return text.replace("\n", "") if text is not None and i is not None and i % 2 == 0 else text


@pytest.mark.parametrize("sources", [["a"], [None, "", "a", "b", "é", "Z", "zz", "a b"], [None]])
def test_awkward_rows_against_plain_python(spark, sources):
    rng = random.Random(len(sources))
    docs = [(i, t, rng.choice(sources)) for i, t in awkward()]
    docs += [(500 + k, "line\nline" if k % 3 else None, sources[0]) for k in range(20)]  # a group with most rows
    assert spark_rows(spark, docs) == plain(docs, tamper)


@pytest.mark.parametrize("n", [1, 3, 4, 28])
def test_sizes_around_powers_of_the_fanout(spark, n):
    docs = [(k, f"text\n{k}", "one") for k in range(n)] + [(1000, "alone", "two")]
    assert spark_rows(spark, docs) == plain(docs, tamper)


def test_only_tampered_rows_fail(spark):
    docs = [(k, "a\nb" if k < 10 else "a b", f"s{k % 3}") for k in range(40)]
    bad = {r[0] for r in spark_rows(spark, docs) if r[4] != r[6]}
    assert bad == {0, 2, 4, 6, 8}


def test_paths_do_not_depend_on_partitions(spark):
    docs = [(k % 50, f"t{k}", f"s{k % 2}") for k in range(200)]  # ids with ties
    assert spark_rows(spark, docs, 1) == spark_rows(spark, docs, 7)


def test_an_empty_table_and_no_alteration(spark):
    assert merkle_manifest(empty(spark), ["doc_id", "text"], group_col="id").collect() == []
    made = merkle_manifest(frame(spark, awkward()), ["doc_id", "text"], group_col="id")
    assert made.where("leaf <> altered_leaf").count() == 0 and made.where(fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
