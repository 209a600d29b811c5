"""Session helpers of the ledger."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without and gets a temporary one."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="tallyspark-checkpoint-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", hot_rows: int = 100_000, hot_share: float = 1 / 1024) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and in ``weight`` how many rows of ``left`` have it.

    Keys with more than ``hot_rows`` rows and ``hot_share`` of all are broadcast, and
    there are fewer of them than the inverse of that share; their rows stay where they are.
    """
    seen = right.agg(F.max(weight).alias("most"), F.sum(weight).alias("total")).first()
    least = max(hot_rows, int((seen["total"] or 0) * hot_share))
    if (seen["most"] or 0) <= least:
        return left.join(right.drop(weight), key, how)
    hot = F.broadcast(right.where(F.col(weight) > least).drop(weight))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(weight) <= least).drop(weight), key, how)
    return left.join(hot, key).unionByName(cold)


def computed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` behind a generator: what reads its columns stays above it, where over a plain projection the optimiser may
    repeat the expressions below in every place that uses them, term by term.  ``keys`` go past the generator, so rows stay known to be partitioned by them."""
    return df.select(*keys, F.inline(F.array(F.struct(*[c for c in df.columns if c not in keys]))))


def bounded(df: DataFrame, *keys: str, most: int = 100_000) -> DataFrame:
    """``df``, whose rows are cheap to count, in partitions by ``keys`` of about ``most`` rows, however many rows it has.  Otherwise Spark
    goes by compressed bytes, of which small rows have so few that a task's sorts grow with the table."""
    n = df.count() // most
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df
