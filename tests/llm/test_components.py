import random

import pytest
from tallyspark.llm.components import connected_components
from tallyspark.llm.runtime import spread_join


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def shapes():
    rng = random.Random(3)
    yield [(i, i + 1) for i in range(60)]  # a sorted path
    yield [(0, i) for i in range(1, 80)]  # a star
    yield [(i, 1000 - i) for i in range(40)] + [(5, 5), (None, 3), (3, None), (7, 993), (7, 993)]
    yield [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]


@pytest.mark.parametrize("finish, hot", [(0, 100_000), (10, 100_000), (10_000, 100_000), (0, 5)])
def test_components_equal_union_find(spark, finish, hot):
    for edges in shapes():
        df = spark.createDataFrame(edges, "s long, d long")
        groups = {}
        for r in connected_components(df, "s", "d", finish_edges=finish, hot_rows=hot).collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, groups.values())) == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "s string, d string"), "s", "d").count() == 0


def test_hot_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(k % 40 if k < 80 else 7, k) for k in range(300)] + [(None, -1), (99, -2)], "k long, x long")
    right = spark.createDataFrame([(k, f"r{k}", 222 if k == 7 else 2) for k in range(35)], "k long, y string, n long")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, rows.join(right.drop("n"), "k", how).collect()), key=str)
        spread = spread_join(rows, right, "k", "n", how, hot_rows=10)
        assert sorted(map(tuple, spread.select("k", "x", "y").collect()), key=str) == plain
        assert "Union" in spread._jdf.queryExecution().toString()
