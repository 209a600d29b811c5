"""Statements of an issuer as files: one per statement and one of all, checked against what each statement declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the files.
COLUMNS = ("period_start", "period_end", "date_op", "description", "amount", "locator", "statement_id")


class Mismatch(ValueError):
    """Some statement does not agree with what it declares."""


def locator_place(locator: Column) -> tuple[Column, Column]:
    """Sort keys of locators: the number behind the last colon, as a number however long, then the text."""
    return F.substring_index(locator, ":", -1).try_cast("long"), locator


def _key(*columns: str) -> list[str]:
    return ["account_id", *columns]


def check_statements(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """``(statement_id, state, problems, n)``: ``OK``, ``NO_CUADRA`` with its problems, or ``DUPLICADO`` for the same account, period and content as an earlier statement.

    Statements have ``account_id``, period, opening and closing balance and what they
    declare; rows have ``locator, date_op, description, amount_minor, doubtful``.  Rows
    without amount, doubtful rows, balances that are missing or do not add up, and
    numbers or totals that differ are problems, and so is another content for a known
    period.  Statements without rows are checked like others.
    """
    place, text = locator_place(F.col("locator"))
    line = F.concat_ws("\x1f", F.col("date_op").cast("string"), F.col("amount_minor").cast("string"), "description")
    seen = rows.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount_minor").isNull()).alias("_missing"), F.count_if("doubtful").alias("_doubtful"), F.sum(F.greatest("amount_minor", F.lit(0))).alias("_credits"), F.sum(F.least("amount_minor", F.lit(0))).alias("_debits"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("t"), line.alias("l")))), lambda x: x["l"]), "\x1e"), 256).alias("_content"),
    )
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("n", "_missing", "_doubtful", "_credits", "_debits")} | {"_content": F.coalesce("_content", F.lit(""))}
    whole = statements.join(seen, "statement_id", "left").withColumns(filled)
    period = whole.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("period_start", "period_end")})
    first = period.groupBy(*_key("period_start", "period_end")).agg(F.min("statement_id").alias("_first"), F.min_by("_content", "statement_id").alias("_known"))
    told = period.join(first, _key("period_start", "period_end"))
    later, same = F.col("statement_id") != F.col("_first"), F.col("_content") == F.col("_known")
    off = F.col("opening_minor") + F.col("_credits") + F.col("_debits") - F.col("closing_minor")
    said = lambda test, *parts: F.when(test, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    number = lambda c: F.col(c).cast("string")
    problems = F.array_compact(F.array(
        said(F.col("_missing") > 0, number("_missing"), " rows without amount"), said(F.col("_doubtful") > 0, number("_doubtful"), " doubtful rows"), said(off.isNull(), "opening or closing balance missing"), said(off != 0, "balances differ by ", off.cast("string")),
        said(F.col("declared_count") != F.col("n"), "declares ", number("declared_count"), " rows, has ", number("n")), said(F.col("declared_credits") != F.col("_credits"), "declares credits ", number("declared_credits"), ", has ", number("_credits")),
        said(-F.abs("declared_debits") != F.col("_debits"), "declares debits ", number("declared_debits"), ", has ", number("_debits")), said(later & ~same, "another content than ", F.col("_first").cast("string"), " for the same period"),
    ))
    state = F.when(later & same, "DUPLICADO").when(F.size(problems) > 0, "NO_CUADRA").otherwise("OK")
    return told.select("statement_id", state.alias("state"), problems.alias("problems"), F.col("n").cast("long").alias("n"))


def consolidated_rows(statements: DataFrame, rows: DataFrame, checked: DataFrame) -> DataFrame:
    """The rows of all statements but duplicates, with the columns of the files."""
    minor = F.abs("amount_minor")
    amount = F.concat(F.when(F.col("amount_minor") < 0, "-").otherwise(""), F.floor(minor / 100).cast("string"), F.lit("."), F.lpad((minor % 100).cast("string"), 2, "0"))
    kept = statements.select("statement_id", "period_start", "period_end").join(checked.where("state <> 'DUPLICADO'").select("statement_id"), "statement_id", "left_semi")
    return rows.withColumn("amount", amount).join(kept, "statement_id").select(*COLUMNS)


def export_consolidated(statements: DataFrame, rows: DataFrame, folder: str, strict: bool = True) -> DataFrame:
    """Writes ``by_statement/statement=<id>/`` and ``all/``, CSV parts in order of period and locator, and returns the checked statements.

    Files of single statements are written whatever their state.  ``all`` is written
    too unless ``strict`` finds a statement that does not agree: then ``Mismatch`` names some.
    """
    checked = check_statements(statements, rows)
    lines = consolidated_rows(statements, rows, checked)
    place, text = locator_place(F.col("locator"))
    keyed = lines.withColumn("statement", F.col("statement_id"))
    keyed.hint("rebalance", "statement").sortWithinPartitions("statement", place, text).write.mode("overwrite").option("header", "true").partitionBy("statement").csv(f"{folder}/by_statement")
    wrong = [(r["statement_id"], r["problems"]) for r in checked.where("state = 'NO_CUADRA'").orderBy("statement_id").limit(20).collect()]
    if wrong and strict:
        raise Mismatch("; ".join(f"{k}: {', '.join(p)}" for k, p in wrong))
    lines.orderBy("period_start", place, text, "statement_id").write.mode("overwrite").option("header", "true").csv(f"{folder}/all")
    return checked
