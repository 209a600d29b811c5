"""Session helpers shared by the operators: durable cuts of lineage, joins on hot keys, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of all rows, so there are fewer hot keys than its inverse, ...
HOT_SHARE = 1 / 1024
#: ... and more rows than one task should take.
HOT_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local master may go without and gets a temporary one."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="tallyspark-checkpoint-")
    context.setCheckpointDir(wanted)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that no lost executor takes it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_alone(df: DataFrame) -> DataFrame:
    """``durable``, and the shuffle files that made it go as soon as it is there, not when the driver next collects garbage."""
    shared_dir(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under this setting
    finally:
        conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into a compressed table in the shared folder: for rows that carry whole texts."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and, in ``weight``, how many rows of ``left`` have that key.

    Rows with a hot key are not gathered: those keys, fewer than ``1 / HOT_SHARE``
    since their weights add up to the rows of ``left``, are broadcast.  ``right``
    should be durable; it is read for its largest weight.
    """
    seen = right.agg(F.max(weight).alias("most"), F.sum(weight).alias("total")).first()
    least = max(hot_rows, int((seen["total"] or 0) * HOT_SHARE))
    if (seen["most"] or 0) <= least:
        return left.join(right.drop(weight), key, how)
    hot = F.broadcast(right.where(F.col(weight) > least).drop(weight))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(weight) <= least).drop(weight), key, how)
    return left.join(hot, key).unionByName(cold)
