"""The ledger as a stream: deduplication under a watermark, windows, and the batch commit per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Movements may arrive this late; the bound is the one dates are resolved by.
LATENESS = "45 days"


def with_event_time(rows: DataFrame, day: str = "date_op") -> DataFrame:
    """Adds ``op_ts``: watermarks need a TIMESTAMP, neither DATE nor one without zone will do."""
    return rows.withColumn("op_ts", F.col(day).cast("timestamp_ltz"))


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(folder)


def deduplicated(rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Each movement once, state being dropped behind the watermark."""
    return with_event_time(rows).withWatermark("op_ts", LATENESS).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, size: str = "7 days", slide: str | None = None) -> DataFrame:
    """Counts and sums by account and tumbling or sliding window."""
    w = F.window("op_ts", size, slide) if slide else F.window("op_ts", size)
    return with_event_time(rows).withWatermark("op_ts", LATENESS).groupBy("account_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total_minor"))


def sessions(rows: DataFrame, gap: str = "3 days") -> DataFrame:
    return with_event_time(rows).withWatermark("op_ts", LATENESS).groupBy("account_id", F.session_window("op_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def transfer_candidates(rows: DataFrame, days: int = 3) -> DataFrame:
    """Debits joined with credits of one amount, streams on both sides, state bounded by the time range."""
    timed = with_event_time(rows).withWatermark("op_ts", LATENESS)
    d = timed.where("amount_minor < 0").select(F.col("transaction_id").alias("from_id"), F.col("account_id").alias("from_account"), (-F.col("amount_minor")).alias("m"), F.col("op_ts").alias("from_ts"))
    c = timed.where("amount_minor > 0").select(F.col("transaction_id").alias("to_id"), F.col("account_id").alias("to_account"), F.col("amount_minor").alias("m2"), F.col("op_ts").alias("to_ts"))
    near = F.expr(f"m = m2 AND from_account <> to_account AND to_ts BETWEEN from_ts - INTERVAL {days} DAYS AND from_ts + INTERVAL {days} DAYS")
    return d.join(c, near).select("from_id", "to_id", F.col("m").alias("amount_minor"))


def commit_stream(rows: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``commit(batch, batch_id)`` for what is available; a repeated batch has the same id, and commits skip what they know."""
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
