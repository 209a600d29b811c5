"""A Merkle manifest of a table: a tree of hashes per group, and one over the groups' roots.

Leaves are numbered within their group and level after level is made by DataFrame
operations: a node's index divided by the fanout is its parent's, a group's sorted
children are hashed into it.  Proofs are joined level by level from the root down:
a parent hands its path to its children, each of which puts its own siblings before
it.  A level has a third of the rows of that below, so all joins together move one
and a half rows per leaf, whatever the number of levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import durable, parallelism

#: Levels between two cuts of the lineage of the proofs.
CUT_EVERY = 8


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def written(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else the number of its UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place in ``tree`` by ``order``, and ``size``, the tree's rows.

    Rows are dealt by range, so that a tree with a third of all rows is many parts;
    ``row_number`` counts inside a part, and sums of the earlier parts' counts, of
    which a tree has one a part at most, are added.
    """
    dealt = durable(rows.repartitionByRange(2 * parallelism(rows.sparkSession), "tree", *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("tree", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    nth = F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(parts, ["tree", "_part"]).withColumn("idx", F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def _parents(nodes: DataFrame, fanout: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The next level, ``(tree, idx, size, node, alone, children)``: at most ``fanout`` neighbours hashed into a parent.

    A tree of one node stays as it is and is marked ``alone``.
    """
    up = nodes.groupBy("tree", F.floor(F.col("idx") / fanout).alias("parent"), "size").agg(F.sort_array(F.collect_list(F.struct("idx", "node", *carry))).alias("children"))
    alone = F.col("size") == 1
    hashed = F.sha2(F.array_join(F.transform("children", lambda c: c["node"]), ""), 256)
    return up.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("size") / fanout).alias("size"), F.when(alone, F.col("children")[0]["node"]).otherwise(hashed).alias("node"), alone.alias("alone"), "children")


def _levels(rows: DataFrame, order: list[str], carry: tuple[str, ...], fanout: int) -> list[DataFrame]:
    """All levels above the leaves ``(tree, node, *carry)``, each kept in the shared folder."""
    levels = [durable(_parents(_numbered(rows, order), fanout, carry))]
    widest = levels[0].agg(F.max("size")).first()[0] or 0
    while widest > 1:
        levels.append(durable(_parents(levels[-1].where("size > 1"), fanout)))
        widest = -(-widest // fanout)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``(tree, node, height)``: what remains of every tree, and the level it stands on."""
    return reduce(DataFrame.union, (level.where("size = 1").select("tree", "node", F.lit(k).alias("height")) for k, level in enumerate(levels, 1)))


def _descend(levels: list[DataFrame], tops: DataFrame, told: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """``(tree, node, *carry, path, *told)`` of every leaf, from ``(tree, height, path, *told)`` of the trees' tops.

    ``path`` has, from the leaf up, what is hashed before and after the node.
    """
    above = None
    for k in range(len(levels), 0, -1):
        here = tops.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("idx"), "path", *told)
        here = here if above is None else here.unionByName(above)
        joined = here.join(levels[k - 1].select("tree", "idx", "alone", "children"), ["tree", "idx"])
        spread = joined.select("tree", "path", "alone", "children", *told, F.posexplode("children").alias("_at", "_child"))
        beside = lambda low, size: F.array_join(F.transform(F.slice("children", low, size), lambda c: c["node"]), "")
        step = F.struct(beside(F.lit(1), F.col("_at")).alias("left"), beside(F.col("_at") + 2, F.size("children")).alias("right"))
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path"))).alias("path")
        child = lambda *names: [F.col("_child")[c].alias(c) for c in names]
        above = spread.select("tree", *child("idx"), path, *told, *(child("node", *carry) if k == 1 else ()))
        if k > 1 and k % CUT_EVERY == 0:
            above = durable(above)
    return above.drop("idx")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(path: Column) -> Column:
    """The digests of a proof, level by level from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def merkle_manifest(docs: DataFrame, fields: list[str], group_col: str = "source", id_col: str = "doc_id", altered: dict[str, Column] | None = None, fanout: int = 3) -> DataFrame:
    """``(id, leaf, altered_leaf, subroot, root, path)`` per row.

    A leaf is the hash of ``fields``; a group's leaves ascend by id; roots of
    groups, in the order of their names, make the upper tree.  ``altered`` gives
    fields another value for ``altered_leaf``, which is ``leaf`` without it: folded
    with ``path`` it tells whether the row still is what the manifest was made of.

    Null ids come first, rows with one id follow by their leaf, repeated rows are
    leaves of their own; a null group is a group of its own, the first.  Null
    fields differ from empty ones.  Texts of any length are hashed whole where
    they are read and never shuffled.  Other columns are left alone, whatever
    their names; an empty table has no rows and so no root.
    """
    changed = altered or {}
    named = lambda c: F.col(f"`{c}`")
    group = named(group_col).cast("string")
    leaf = digest(*[written(named(c)) for c in fields])
    # '' for null and '=' before names: one key that sorts as the groups do
    tree = F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree")
    other = F.when(reduce(Column.__or__, [~changed[c].eqNullSafe(named(c)) for c in changed]), digest(*[written(changed.get(c, named(c))) for c in fields])) if changed else F.lit(None).cast("string")
    leaves = durable(docs.select(tree, named(id_col).alias("id"), leaf.alias("node"), other.alias("other")))
    below = _levels(leaves, ["id", "node"], ("id", "other"), fanout)
    tops = durable(_tops(below).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node", F.col("height").alias("group_height")))
    above = _levels(tops, ["name"], ("name", "group_height"), fanout)
    summit = _tops(above).select("tree", "height", F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("path"), F.col("node").alias("root"))
    groups = _descend(above, summit, ("root",), ("name", "group_height"))
    groups = durable(groups.select(F.col("name").alias("tree"), F.col("group_height").alias("height"), "path", "root", F.col("node").alias("subroot")))
    found = _descend(below, groups, ("root", "subroot"), ("id", "other"))
    return found.select("id", F.col("node").alias("leaf"), F.coalesce("other", "node").alias("altered_leaf"), "subroot", "root", "path")
