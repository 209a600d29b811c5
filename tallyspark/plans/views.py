"""Views the named queries share, built alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements from ``events``: outflows are purchases and errors, statements are ten-day periods of a user."""
    e = table(spark, sf_dir, "events")
    cents = (F.round(F.col("value").cast("decimal(18,2)") * 100)).cast("long")
    day = F.col("ts").cast("date")
    return e.select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account_id"), day.alias("date_op"),
        (F.when(F.col("event_type").isin("purchase", "error"), -1).otherwise(1) * cents).cast("long").alias("amount_minor"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("bank_ref"), F.col("event_type").alias("description"),
        (F.col("user_id") * 10 + F.expr("(dayofmonth(ts) - 1) div 10")).cast("long").alias("statement_id"), "ts",
    )


#: The same view for DuckDB, to begin a WITH list.
TXN = """txn AS (
  SELECT event_id AS transaction_id, user_id AS account_id, CAST(ts AS DATE) AS date_op,
    CAST((CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END) * CAST(round(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT) AS BIGINT) AS amount_minor,
    regexp_extract(props, '([0-9]+)', 1) AS bank_ref, event_type AS description,
    CAST(user_id * 10 + (day(ts) - 1) // 10 AS BIGINT) AS statement_id, ts
  FROM events)"""


def declared(rows: DataFrame) -> DataFrame:
    """Statements of ``txn`` with what they declare: every seventh user is a cent off, every eleventh lacks a balance, every fifth counts one too many."""
    s = rows.groupBy("statement_id", "account_id").agg(F.sum("amount_minor").alias("net"), F.count(F.lit(1)).alias("n"))
    u, opening = F.col("account_id"), F.col("account_id") * 100
    closing = F.when(u % 11 == 0, F.lit(None)).otherwise(opening + F.col("net") + F.when(u % 7 == 0, 1).otherwise(0))
    return s.select(
        "statement_id", "account_id", opening.cast("long").alias("opening_minor"), closing.cast("long").alias("closing_minor"), (F.col("n") + F.when(u % 5 == 0, 1).otherwise(0)).alias("declared_count"),
        F.lit(None).cast("long").alias("declared_credits"), F.lit(None).cast("long").alias("declared_debits"),
    )


DECLARED = """declared AS (
  SELECT statement_id, account_id, account_id * 100 AS opening_minor,
    CASE WHEN account_id % 11 = 0 THEN NULL ELSE account_id * 100 + CAST(sum(amount_minor) AS BIGINT) + CASE WHEN account_id % 7 = 0 THEN 1 ELSE 0 END END AS closing_minor,
    count(*) + CASE WHEN account_id % 5 = 0 THEN 1 ELSE 0 END AS declared_count,
    CAST(sum(CASE WHEN amount_minor > 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS credits_minor,
    CAST(sum(CASE WHEN amount_minor < 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS debits_minor, count(*) AS n_transactions
  FROM txn GROUP BY statement_id, account_id)"""
