"""Views over a committed ledger: audit, quarantine, closing, summaries, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.money import from_minor
from ..functions.text import csv_safe

# Columns of the export contract, in order.
EXPORT_COLUMNS = ("transaction_id", "fecha", "cuenta", "institucion", "descripcion", "categoria", "tipo", "importe", "moneda", "ingreso_gasto", "es_transferencia", "estado_revision", "bank_ref", "fingerprint")
CONTRACT_VERSION = "1.1.0"


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; later columns of ``order`` break ties."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counts, income and expense (transfers included), accounts, months, and where the columns are there rows with flags and to review."""
    inflow = F.when(F.col("amount_minor") > 0, F.col("amount_minor")).otherwise(0)
    outflow = F.when(F.col("amount_minor") < 0, F.col("amount_minor")).otherwise(0)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(inflow), F.lit(0)).alias("income_minor"), F.coalesce(F.sum(outflow), F.lit(0)).alias("expense_minor"),
        F.countDistinct("account_id").alias("n_accounts"), F.countDistinct(month_key(F.col("date_op"))).alias("n_months"),
        *([F.count_if(F.size("flags") > 0).alias("n_flagged")] if "flags" in rows.columns else []),
        *([F.count_if(F.col("review_status") != "ok").alias("n_to_review")] if "review_status" in rows.columns else []),
    )


def quarantine_by_month(rows: DataFrame, fallback: str = "period_start", estimate: str = "estimate_minor") -> DataFrame:
    """Per statement and month the number of rows and the sum of absolute amounts, estimates where amounts are unreadable."""
    month = month_key(F.coalesce("date_op", fallback)).alias("month")
    size = F.abs(F.coalesce("amount_minor", estimate, F.lit(0)))
    return rows.groupBy("statement_id", month).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("total_minor"))


def audit_month(accounts: DataFrame, statements: DataFrame, rows: DataFrame, checks: DataFrame, month: str) -> DataFrame:
    """Per active account: statements and rows of the month (by period end and date), the latest verdict on a statement of that month, and whether it is closed."""
    of_month = statements.where(month_key(F.col("period_end")) == month)
    by_account = of_month.groupBy("account_id").agg(F.countDistinct("statement_id").alias("n_statements"))
    n_rows = rows.where(month_key(F.col("date_op")) == month).groupBy("account_id").agg(F.count(F.lit(1)).alias("n_rows"))
    last = latest_by(checks.join(of_month.select("statement_id").distinct(), "statement_id", "left_semi"), ["account_id"], ["created_at", "statement_id"]).select("account_id", F.col("result").alias("latest_result"))
    out = accounts.where("active").select("account_id").join(by_account, "account_id", "left").join(n_rows, "account_id", "left").join(last, "account_id", "left")
    out = out.withColumn("n_statements", F.coalesce("n_statements", F.lit(0))).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumn("closed", (F.col("n_statements") > 0) & F.coalesce(F.col("latest_result") == "OK", F.lit(False)))


def quarantine_totals(held: DataFrame, rows: DataFrame) -> DataFrame:
    """``(account_id, month, n, amount_minor)`` of what is kept back: held statements ``(account_id, month, n, amount_minor)`` and committed rows in quarantine."""
    single = rows.where("review_status = 'cuarentena' AND dup_of IS NULL").select("account_id", month_key(F.col("date_op")).alias("month"), F.lit(1).cast("long").alias("n"), F.abs("amount_minor").alias("amount_minor"))
    both = held.select("account_id", "month", F.col("n").cast("long").alias("n"), "amount_minor").unionByName(single)
    return both.groupBy("account_id", "month").agg(F.sum("n").alias("n"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("amount_minor"))


def contract_totals(held: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: statements and movements that are held back with their amounts, and committed movements under review with theirs."""
    single = rows.where("review_status = 'cuarentena' AND dup_of IS NULL").select(F.lit("review").alias("_kind"), F.lit(1).cast("long").alias("n"), F.abs("amount_minor").alias("amount_minor"))
    both = held.select(F.lit("held").alias("_kind"), F.col("n").cast("long").alias("n"), "amount_minor").unionByName(single)
    total = lambda kind, c: F.coalesce(F.sum(F.when(F.col("_kind") == kind, F.col(c))), F.lit(0).cast("long"))
    return both.agg(
        F.count_if(F.col("_kind") == "held").alias("quarantine_statements"), total("held", "n").alias("quarantine_txns"), total("held", "amount_minor").alias("quarantine_amount_minor"),
        total("review", "n").alias("review_txns"), total("review", "amount_minor").alias("review_amount_minor"),
    )


#: Verdicts from good to bad.
VERDICTS = ("OK", "WARNING", "REVIEW_REQUIRED", "BLOCKED")


def month_verdicts(statements: DataFrame) -> DataFrame:
    """``(account_id, month, result)``: the worst verdict on the statements that end in the month."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("result")), F.lit(len(VERDICTS)).cast("long"))
    rows = statements.select("account_id", month_key(F.col("period_end")).alias("month"), rank.cast("int").alias("_r")).where("month IS NOT NULL")
    return rows.groupBy("account_id", "month").agg(F.max("_r").alias("_r")).select("account_id", "month", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("_r")).alias("result"))


def close_status(months: DataFrame, quarantine: DataFrame) -> DataFrame:
    """``(account_id, month, status)``: pending while the last verdict is not OK or rows are in quarantine."""
    waiting = quarantine.select("account_id", "month").distinct().withColumn("_q", F.lit(True))
    joined = months.join(waiting, ["account_id", "month"], "left")
    return joined.select("account_id", "month", F.when((F.col("result") == "OK") & F.col("_q").isNull(), "closed").otherwise("pending").alias("status"))


def touches_closed_month(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Statements with a row, not a duplicate, in a closed month of its account."""
    live = rows.where("dup_of IS NULL") if "dup_of" in rows.columns else rows
    hit = live.select("statement_id", "account_id", month_key(F.col("date_op")).alias("month")).join(closed.select("account_id", "month"), ["account_id", "month"], "left_semi")
    return hit.select("statement_id").distinct()


def export_rows(rows: DataFrame, accounts: DataFrame, institutions: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Exportable rows in the contract's columns: not superseded, not in quarantine."""
    live = rows.where("dup_of IS NULL AND review_status <> 'cuarentena'")
    joined = live.join(accounts.select("account_id", F.col("name").alias("cuenta"), "institution_id"), "account_id").join(institutions.select("institution_id", F.col("name").alias("institucion")), "institution_id")
    if links is not None:
        ends = links.select(F.col("from_id").alias("transaction_id")).union(links.select("to_id")).distinct().withColumn("_t", F.lit(True))
        joined = joined.join(ends, "transaction_id", "left").withColumn("es_transferencia", F.coalesce("_t", F.lit(False)))
    else:
        joined = joined.withColumn("es_transferencia", F.lit(False))
    cell = lambda name, value=None: csv_safe(value if value is not None else F.col(name)).alias(name)
    return joined.select(
        "transaction_id", F.col("date_op").alias("fecha"), cell("cuenta"), cell("institucion"), cell("descripcion", F.coalesce(F.nullif("description_norm", F.lit("")), "description_raw") if "description_raw" in rows.columns else F.col("description_norm")),
        cell("categoria", F.col("category")), F.col("type").alias("tipo"), F.abs(from_minor(F.col("amount_minor"), F.col("currency"))).alias("importe"), F.col("currency").alias("moneda"),
        F.when(F.col("amount_minor") > 0, "Ingreso").otherwise("Gasto").alias("ingreso_gasto"), F.col("es_transferencia").cast("int").alias("es_transferencia"), F.col("review_status").alias("estado_revision"),
        cell("bank_ref", F.coalesce("bank_ref", F.lit(""))), "fingerprint",
    )


def export_totals(exported: DataFrame) -> DataFrame:
    """Number of rows, income and expense, as a contract states them."""
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("ingreso_gasto") == kind, F.col("importe"))), F.lit(0)).cast("decimal(28,2)")
    return exported.agg(F.count(F.lit(1)).alias("n"), part("Ingreso").alias("income"), part("Gasto").alias("expense"))


def first_rows(rows: DataFrame, key: str, order: list[str], n: int = 12) -> DataFrame:
    """A preview: the first rows of each statement."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def ledger_rollup(rows: DataFrame, how: str = "rollup") -> DataFrame:
    """Sums by month, account and kind, with subtotals (``rollup``) or over all combinations (``cube``)."""
    keys = [month_key(F.col("date_op")).alias("month"), "account_id", "description"]
    grouped = rows.rollup(*keys) if how == "rollup" else rows.cube(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total_minor"), F.grouping_id().cast("long").alias("level"))
