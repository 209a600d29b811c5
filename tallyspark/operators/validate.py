"""Validation of rows and statements, blocks, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies of the ledger.
TYPES = ("ingreso", "gasto", "pago_deuda", "transferencia", "comision", "interes", "aportacion_ahorro", "aportacion_inversion")
CATEGORY_SOURCES = ("rule", "history", "ai", "manual", "none")
REVIEW_STATES = ("ok", "por_revisar", "cuarentena")
METHODS = "^(csv|xlsx|pdf_text|pdf_no_text|ocr|image|pdf(_ocr|_ebcdic)?_template:[a-z0-9_]+)$"
BLOCK_ON = (
    "reconciliation_blocked", "missing_critical_fields", "invalid_schema", "account_not_identified", "inactive_account", "currency_mismatch", "unsupported_currency",
    "duplicate_statement", "documento_excede_limite",
)
CURRENCIES = ("MXN", "USD", "EUR", "GBP", "CAD", "BRL", "ARS", "CLP", "JPY", "COP", "PEN")
TRANSITIONS = {
    "DISCOVERED": ("HASHED", "FAILED"),
    "HASHED": ("EXTRACTED", "FAILED"),
    "EXTRACTED": ("NORMALIZED", "FAILED"),
    "NORMALIZED": ("VALIDATED", "FAILED"),
    "VALIDATED": ("REVIEW_REQUIRED", "READY_TO_COMMIT", "FAILED"),
    "REVIEW_REQUIRED": ("READY_TO_COMMIT", "FAILED"),
    "READY_TO_COMMIT": ("COMMITTED", "FAILED"),
    "COMMITTED": ("EXPORTED", "EXPORT_FAILED", "ROLLED_BACK", "FAILED"),
    "EXPORT_FAILED": ("EXPORTED", "ROLLED_BACK", "FAILED"),
    "EXPORTED": ("EXCEL_VERIFIED", "ROLLED_BACK", "FAILED"),
    "EXCEL_VERIFIED": ("ROLLED_BACK",),
    "FAILED": (),
    "ROLLED_BACK": (),
}


#: Columns that rows are checked by where they stand alone.
ROW_COLUMNS = ("transaction_id", "account_id", "date_op", "amount_minor", "currency", "sign", "type")
CANONICAL_COLUMNS = (*ROW_COLUMNS, "statement_id", "description_raw", "fingerprint", "category_source", "review_status")


def row_errors(columns: tuple[str, ...] = ROW_COLUMNS, loose_ids: bool = True) -> Column:
    """Sorted names of what is wrong with a canonical row, of the given columns; empty if nothing is.

    Nullable are the dates of charge and value, which are typed, the kind and the
    source of a category; ``columns`` leaves out checks of columns a table lacks.
    """
    c = F.col
    sure = lambda test: F.coalesce(test, F.lit(False))
    checks = {
        "transaction_id": sure(c("transaction_id").rlike("^txn_")) if loose_ids else sure(c("transaction_id").rlike("^txn_[0-9a-f]{16}$")), "account_id": c("account_id").isNotNull(),
        "statement_id": sure(c("statement_id").rlike("^stmt_[0-9a-f]{16}$")), "date_op": c("date_op").isNotNull(), "description_raw": c("description_raw").isNotNull(), "amount_minor": c("amount_minor").isNotNull(),
        "currency": sure(c("currency").rlike("^[A-Z]{3}$")), "sign": sure(c("sign").isin(-1, 1)), "type": c("type").isNull() | c("type").isin(*TYPES), "fingerprint": c("fingerprint").isNotNull(),
        "category_source": c("category_source").isNull() | c("category_source").isin(*CATEGORY_SOURCES), "review_status": sure(c("review_status").isin(*REVIEW_STATES)),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(~test, name) for name, test in checks.items() if name in columns])))


def statement_errors() -> Column:
    """Sorted names of what is wrong with a statement ``(statement_id, account_id, file_sha256, original_name, currency, method, period_start, period_end)``."""
    c = F.col
    sure = lambda test: F.coalesce(test, F.lit(False))
    return F.array_sort(F.array_compact(F.array(
        F.when(~sure(c("statement_id").rlike("^stmt_[0-9a-f]{16}$")), "statement_id"), F.when(c("account_id").isNull(), "account_id"),
        F.when(~sure(c("file_sha256").rlike("^[0-9a-f]{64}$")), "file_sha256"), F.when(c("original_name").isNull(), "original_name"), F.when(~sure(c("currency").rlike("^[A-Z]{3}$")), "currency"),
        F.when(c("method").isNotNull() & ~c("method").rlike(METHODS), "method"), F.when(sure(c("period_start") > c("period_end")), "period"),
    )))


def native_source(method: Column) -> Column:
    """Whether amounts carry the issuer's own signs: documents read by an issuer's grammar, from text, recognised or mainframe glyphs."""
    return F.coalesce(method.rlike("^pdf(_ocr|_ebcdic)?_template:"), F.lit(False))


def cap_rows(rows: DataFrame, key: str, order: list[str], cap: int = 5000) -> DataFrame:
    """At most ``cap`` rows per statement, the first ones, each with ``over_limit``: this cap is the feature, the statement is blocked."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    return rows.withColumn("over_limit", F.count(F.lit(1)).over(w) > cap).withColumn("_k", F.row_number().over(w.orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def statement_blocks(statements: DataFrame) -> DataFrame:
    """Adds ``blocks``, sorted; uses ``account_id, account_active, account_currency, currency, n_doubtful, n_invalid, over_limit``."""
    c = F.col
    return statements.withColumn("blocks", F.array_sort(F.array_compact(F.array(
        F.when(c("account_id").isNull(), "account_not_identified"),
        F.when(~c("account_active"), "inactive_account"),
        F.when(~c("currency").isin(*CURRENCIES), "unsupported_currency"),
        F.when(c("currency") != c("account_currency"), "currency_mismatch"),
        F.when(c("n_doubtful") > 0, "missing_critical_fields"),
        F.when(c("n_invalid") > 0, "invalid_schema"),
        F.when(c("over_limit"), "documento_excede_limite"),
    ))))


def decide_state(blocks: Column, result: Column, block_on: tuple[str, ...] = BLOCK_ON) -> Column:
    """REVIEW_REQUIRED with a hard block or an imperfect reconciliation, else READY_TO_COMMIT."""
    hard = F.array_intersect(blocks, F.array(*map(F.lit, block_on)))
    return F.when((F.size(hard) > 0) | (result != "OK") | result.isNull(), "REVIEW_REQUIRED").otherwise("READY_TO_COMMIT")


def transitions(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, many in TRANSITIONS.items() for b in many], "src string, dst string")


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Changes ``(src, dst, ...)`` that the state machine does not know."""
    return changes.join(transitions(changes.sparkSession), ["src", "dst"], "left_anti")


def revalidate(staged: DataFrame, fresh: DataFrame, columns: list[str], key: str = "transaction_id") -> DataFrame:
    """Keys whose staged columns differ from freshly derived ones, or that only one side has."""
    a, b = staged.select(key, F.struct(*columns).alias("a")), fresh.select(key, F.struct(*columns).alias("b"))
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def may_approve(blocks: Column, block_on: tuple[str, ...] = BLOCK_ON) -> Column:
    """Whether a review may be closed by hand: not against a hard block, oversized documents included."""
    return F.size(F.array_intersect(blocks, F.array(*map(F.lit, block_on)))) == 0


def commit_problems(statements: DataFrame, rows: DataFrame, accounts: DataFrame, categories: tuple[str, ...] = (), preview: tuple[str, ...] = ("result", "diff_minor", "credits_minor", "debits_minor", "n_transactions")) -> DataFrame:
    """``(statement_id, problem)`` of staged statements that no longer hold when they are committed.

    Statements and rows are checked again as they were, against the accounts of
    now: identifiers that do not follow from their fields, other currencies, kinds
    and categories that are not in the catalogue, inverted periods, accounts that
    went, and a reconciliation that differs from the preview.
    """
    from ..functions import ids
    from . import reconcile

    c = F.col
    now = accounts.select("account_id", c("active").alias("_active"), F.upper("currency").alias("_currency"), F.lit(True).alias("_known"))
    s = statements.join(now, "account_id", "left")
    found = F.array_compact(F.array(
        F.when(c("_known").isNull(), "account_not_identified"), F.when(~c("_active"), "inactive_account"), F.when(c("_currency") != F.upper("currency"), "currency_mismatch"), F.when(c("period_start") > c("period_end"), "inverted period"),
    ))
    about_statements = s.select("statement_id", F.explode(found).alias("problem"))
    derived = ids.transaction_id(c("account_id"), c("statement_id"), c("date_op"), c("amount_minor"), c("description_raw"), c("bank_ref"), c("locator"))
    r = rows.join(statements.select("statement_id", F.upper("currency").alias("_ccy")), "statement_id")
    wrong = F.array_compact(F.array(
        F.when(~derived.eqNullSafe(c("transaction_id")), "transaction_id does not follow from its fields"), F.when(~F.upper("currency").eqNullSafe(c("_ccy")), "currency of a row differs"),
        F.when(~F.coalesce(c("type").isin(*TYPES), F.lit(True)), "type not in the catalogue"), F.when(c("amount_minor").isNotNull() & (F.size(row_errors(CANONICAL_COLUMNS, False)) > 0), "invalid_schema"),
        *([F.when((F.trim("category") != "") & ~c("category").isin(*categories), "category not in the catalogue")] if categories else []),
    ))
    about_rows = r.select("statement_id", F.explode(wrong).alias("problem")).distinct()
    given = [x for x in preview if x in statements.columns]
    base = statements.drop(*[x for x in ("credits_minor", "debits_minor", "n_transactions", "computed_closing_minor", "diff_minor", "coverage_ok", "totals_mismatch", "result") if x in statements.columns])
    again = reconcile.reconcile(base, rows.where("amount_minor IS NOT NULL") if "amount_minor" in rows.columns else rows).select("statement_id", *[c(x).alias(f"_{x}") for x in given])
    differs = F.lit(False)
    for x in given:
        differs = differs | ~c(x).eqNullSafe(c(f"_{x}"))
    about_sums = statements.join(again, "statement_id").where(differs).select("statement_id", F.lit("reconciliation differs from the preview").alias("problem"))
    return about_statements.union(about_rows).union(about_sums)
