"""Connected components over an edge table, by randomised contraction.

Each round every node points to the node with the smallest hash, under that
round's seed, among its neighbours and their neighbours, and the graph is
contracted along the pointers.  All steps are map-side combined aggregations and
equi-joins, in which nodes with very many edges are broadcast (their number is
bounded, see ``spread_join``), so a node with a third of all edges needs no single
task; a star vanishes in one round, and whatever the shape of the graph a fixed
share of the nodes is expected to.  When at most ``finish_edges`` edges are left, a constant
however large the input, one task finishes them by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import HOT_ROWS, durable, spread_join


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition of edges; the root of a component is its smallest node."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    if kind is not None:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "to"])


def _contract(live: DataFrame, seed: int, hot_rows: int) -> DataFrame:
    """``(node, to, degree)``: the node of smallest hash within two steps of each node."""
    ranked = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("n"))
    both = live.union(live.select("b", "a"))
    near = durable(both.groupBy("a").agg(F.min(F.least(ranked("a"), ranked("b"))).alias("best"), F.count(F.lit(1)).alias("degree")))
    met = spread_join(both.toDF("a", "via"), near.toDF("via", "best", "degree"), "via", "degree", hot_rows=hot_rows)
    found = met.groupBy("a").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("degree"))
    return found.select(F.col("a").alias("node"), F.col("best")["n"].alias("to"), "degree")


def connected_components(edges: DataFrame, src: str, dst: str, finish_edges: int = 10_000, max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; two nodes share a root if and only if a path joins them.

    The root is some node of the component, not always the smallest. Edges with a
    null end and self-loops are ignored; an empty edge table gives an empty
    result. With ``finish_edges`` 0 no Python runs on the executors.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    live = durable(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for seed in range(max_rounds):
        if live.count() <= finish_edges:
            break
        point = durable(_contract(live, seed, hot_rows))
        to = point.select("node", "to")
        if labels is None:
            labels = to.withColumnRenamed("to", "root")
        else:
            members = durable(labels.groupBy("root").agg(F.count(F.lit(1)).alias("members")).join(to.withColumnRenamed("node", "root"), "root", "left"))
            labels = durable(spread_join(labels, members, "root", "members", hot_rows=hot_rows).select("node", F.coalesce("to", "root").alias("root")))
        moved = spread_join(live, point.toDF("a", "ta", "degree"), "a", "degree", hot_rows=hot_rows)
        moved = spread_join(moved, point.toDF("b", "tb", "degree"), "b", "degree", hot_rows=hot_rows)
        live = durable(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    if not finish_edges:
        return live.toDF("node", "root") if labels is None else labels
    kind = live.schema["a"].dataType
    last = durable(live.coalesce(1).mapInArrow(_finish, T.StructType([T.StructField("node", kind), T.StructField("to", kind)])))
    if labels is None:
        return last.withColumnRenamed("to", "root")
    members = durable(labels.groupBy("root").agg(F.count(F.lit(1)).alias("members")).join(last.toDF("root", "to"), "root", "left"))
    return spread_join(labels, members, "root", "members", hot_rows=hot_rows).select("node", F.coalesce("to", "root").alias("root"))
