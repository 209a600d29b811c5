"""Reconciliation of statements against the balances and totals they declare."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tolerance(account: Column, currency: Column, by_account: Mapping[str, int], by_currency: Mapping[str, int], default: int) -> Column:
    """Largest difference allowed, in minor units: the account's, else the currency's, else the default."""
    pick = lambda table, key: F.create_map(*[F.lit(x) for p in table.items() for x in p])[key] if table else F.lit(None).cast("int")
    return F.coalesce(pick({str(k): v for k, v in by_account.items()}, account.cast("string")), pick(by_currency, F.upper(currency)), F.lit(default)).cast("long")


def reconcile(statements: DataFrame, rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """One verdict per statement, also for those without rows.

    ``statements`` has ``key``, ``opening_minor``, ``closing_minor``,
    ``declared_count``, ``declared_credits``, ``declared_debits`` and
    ``tolerance_minor``; ``rows`` has ``key`` and ``amount_minor``.  Without both
    balances a statement is for review; beyond the tolerance it is blocked; with a
    wrong count or wrong totals it is a warning.
    """
    sums = rows.groupBy(key).agg(
        F.sum(F.when(F.col("amount_minor") > 0, F.col("amount_minor")).otherwise(0)).alias("credits_minor"),
        F.sum(F.when(F.col("amount_minor") < 0, F.col("amount_minor")).otherwise(0)).alias("debits_minor"),
        F.count(F.lit(1)).alias("n_transactions"),
    )
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0).cast("long")).alias(name)
    joined = statements.join(sums, key, "left").select(*statements.columns, zero("credits_minor"), zero("debits_minor"), zero("n_transactions"))
    both = c("opening_minor").isNotNull() & c("closing_minor").isNotNull()
    out = joined.withColumn("computed_closing_minor", F.when(both, c("opening_minor") + c("credits_minor") + c("debits_minor")))
    out = out.withColumn("diff_minor", c("computed_closing_minor") - c("closing_minor"))
    out = out.withColumn("coverage_ok", c("declared_count") == c("n_transactions"))
    off = lambda declared, actual: F.coalesce(F.abs(c(declared) - c(actual)) > c("tolerance_minor"), F.lit(False))
    out = out.withColumn("totals_mismatch", off("declared_credits", "credits_minor") | off("declared_debits", "debits_minor"))
    clean = F.coalesce(c("coverage_ok"), F.lit(True)) & ~c("totals_mismatch")
    verdict = F.when(~both, "REVIEW_REQUIRED").when(F.abs("diff_minor") > c("tolerance_minor"), "BLOCKED").when(clean, "OK").otherwise("WARNING")
    return out.withColumn("result", verdict)


def self_check(statements: DataFrame, rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """Statements whose opening plus rows, count, credits or debits differ from what they print; empty if all is well."""
    done = reconcile(statements, rows, key)
    wrong = F.array_compact(F.array(
        F.when(F.col("diff_minor") != 0, "balance"), F.when(~F.col("coverage_ok"), "count"),
        F.when(F.col("declared_credits") != F.col("credits_minor"), "credits"), F.when(F.col("declared_debits") != F.col("debits_minor"), "debits"),
    ))
    return done.withColumn("wrong", wrong).where(F.size("wrong") > 0)


def running_balance(rows: DataFrame, key: str, order: list[str], opening: str = "opening_minor") -> DataFrame:
    """Adds ``balance_minor``, the balance after each row."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance_minor", F.col(opening) + F.sum("amount_minor").over(w))
