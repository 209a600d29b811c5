"""Late rows of a stream are kept apart instead of being dropped.

Spark's stateful operators leave out rows behind the watermark without a word.
Here every micro-batch is split by the watermark that Spark would have for it,
the latest event time of the batches before it less the allowed lateness, and both
parts are written: what is in time goes on, what is late waits with its delay.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_MARK = "batch long, latest timestamp"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class LateSplit:
    """Writes ``rows/batch=N/late=true|false`` and ``marks/batch=N`` below a folder that all executors share.

    A batch that runs again, as after a restart, finds the mark of the batch before
    it and replaces what it wrote, so the split does not depend on failures.
    """

    def __init__(self, spark: SparkSession, folder: str, lateness: dt.timedelta, event_time: str = "op_ts"):
        self.spark, self.folder, self.lateness, self.event_time = spark, folder, lateness, event_time

    def mark(self, number: int) -> dt.datetime | None:
        """The latest event time up to a batch."""
        at = f"{self.folder}/marks/batch={number}"
        if number < 0 or not _exists(self.spark, at):
            return None
        return self.spark.read.schema("latest timestamp").parquet(at).first()["latest"]

    def __call__(self, batch: DataFrame, number: int) -> None:
        mark, when = self.mark(number - 1), F.col(self.event_time).cast("timestamp")
        watermark = F.lit(mark - self.lateness if mark is not None else None).cast("timestamp")
        late = F.coalesce(when < watermark, F.lit(False))
        behind = F.when(late, watermark.cast("double") - when.cast("double")).alias("delay_seconds")
        out = f"{self.folder}/rows/batch={number}"
        batch.select("*", late.alias("late"), behind).write.mode("overwrite").partitionBy("late").parquet(out)
        written = self.spark.read.schema(batch.schema).parquet(out).agg(F.max(when).alias("latest"))
        latest = written.select(F.greatest("latest", F.lit(mark).cast("timestamp")).alias("latest"))
        latest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={number}")

    def read(self) -> DataFrame:
        """All rows with ``late`` and ``delay_seconds``, how far behind the watermark."""
        return self.spark.read.parquet(f"{self.folder}/rows").drop("batch").withColumn("late", F.col("late").cast("boolean"))

    def on_time(self) -> DataFrame:
        return self.read().where("NOT late").drop("late", "delay_seconds")

    def quarantined(self) -> DataFrame:
        return self.read().where("late").drop("late")


def split_late(rows: DataFrame, folder: str, lateness: dt.timedelta, checkpoint: str, event_time: str = "op_ts") -> StreamingQuery:
    """Runs a stream through ``LateSplit`` until what is available has been read; rows without event time are in time."""
    return rows.writeStream.foreachBatch(LateSplit(rows.sparkSession, folder, lateness, event_time)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
