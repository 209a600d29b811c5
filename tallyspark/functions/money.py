"""Money as whole minor units (LONG); no binary floating point anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import computed

# Currencies without decimals, texts that are no amount, largest amount.
NO_DECIMALS = ("CLP", "JPY")
NOT_AMOUNTS = ("", "-", "—", "N/A", "n/a")
MAX_MINOR = 10**15


def exponent(currency: Column) -> Column:
    """Decimals of a currency: 0 for the known exceptions, 2 for all others and null."""
    return F.when(F.upper(currency).isin(*NO_DECIMALS), 0).otherwise(2)


def to_minor(amount: Column, currency: Column) -> Column:
    """Minor units of a decimal amount, halves away from zero; null beyond ``MAX_MINOR``."""
    exact = amount.cast("decimal(38,18)")
    whole = F.when(exponent(currency) == 0, F.round(exact, 0).cast("decimal(28,0)")).otherwise((F.round(exact, 2) * 100).cast("decimal(28,0)"))
    return F.when(F.abs(whole) <= MAX_MINOR, whole.cast("long"))


def from_minor(minor: Column, currency: Column) -> Column:
    """The amount as a decimal with two places (none are used by currencies without decimals)."""
    return (minor.cast("decimal(20,0)") / F.when(exponent(currency) == 0, 1).otherwise(100).cast("decimal(3,0)")).cast("decimal(20,2)")


def format_minor(minor: Column, currency: Column) -> Column:
    """Thousands separated by commas, the currency's decimals and its code."""
    amount = from_minor(minor, currency)
    return F.concat_ws(" ", F.when(exponent(currency) == 0, F.format_number(amount, 0)).otherwise(F.format_number(amount, 2)), F.upper(currency))


def with_parsed_amount(rows: DataFrame, text: str, currency: str | Column, name: str) -> DataFrame:
    """Adds ``name``, the minor units of an amount as statements print it; null where it is unreadable or ambiguous.

    Parentheses and a leading hyphen negate, the rightmost of both separators is
    decimal, a lone comma is decimal before up to two digits, and a lone dot
    before exactly three digits after one to three is ambiguous.
    """
    ccy = F.col(currency) if isinstance(currency, str) else currency
    c = F.col
    out = rows.withColumn("_t", F.regexp_replace(c(text).cast("string"), r"(?U)^\s+|\s+$", ""))
    out = out.withColumn("_wrapped", c("_t").startswith("(") & c("_t").endswith(")"))
    inner = F.when(c("_wrapped"), F.expr("substring(_t, 2, length(_t) - 2)")).otherwise(c("_t"))
    out = out.withColumn("_s", F.regexp_replace(inner, r"[^0-9.,()\-]", ""))
    out = out.withColumn("_minus", c("_s").startswith("-")).withColumn("_hyphens", F.length("_s") - F.length(F.replace("_s", F.lit("-"), F.lit(""))))
    out = out.withColumn("_s", F.regexp_replace("_s", "^-", ""))
    out = out.withColumn("_dots", F.length("_s") - F.length(F.replace("_s", F.lit("."), F.lit("")))).withColumn("_commas", F.length("_s") - F.length(F.replace("_s", F.lit(","), F.lit(""))))
    bare = F.replace("_s", F.lit(","), F.lit(""))
    dotted = F.replace("_s", F.lit(","), F.lit("."))
    number = (
        F.when((c("_dots") > 0) & (c("_commas") > 0), F.when(c("_s").rlike(r"\.[^,]*$"), bare).otherwise(F.replace(F.replace("_s", F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
        .when(c("_commas") > 0, F.when(c("_s").rlike(r",[^,]{0,2}$"), dotted).otherwise(bare))
        .when(c("_dots") > 1, F.replace("_s", F.lit("."), F.lit("")))
        .when(c("_s").rlike(r"^[^.]{1,3}\.[^.]{3}$"), F.lit(None))
        .otherwise(c("_s"))
    )
    out = computed(out.withColumn("_n", number))
    good = ~c("_t").isin(*NOT_AMOUNTS) & (c("_hyphens") <= 1) & c("_n").rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    value = F.when(good, F.expr("try_cast(_n AS decimal(38,18))"))
    signed = F.when(c("_wrapped") != c("_minus"), -value).otherwise(value)
    out = out.withColumn("_v", signed).withColumn(name, to_minor(c("_v"), ccy))
    return out.drop("_t", "_wrapped", "_s", "_minus", "_hyphens", "_dots", "_commas", "_n", "_v")


def sign_of(minor: Column) -> Column:
    """1 for inflows, -1 for outflows and zero, 0 for unknown."""
    return F.when(minor.isNull(), 0).when(minor > 0, 1).otherwise(-1)


def basic_type(minor: Column, description: Column) -> Column:
    """Kind of a movement by its text, else by its sign; null for unknown amounts."""
    d = F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(minor.isNull(), F.lit(None).cast("string"))
        .when(d.rlike("(pago.*tarjeta|pago tdc|abono a tarjeta)"), "pago_deuda")
        .when(d.rlike("(comision|comisión)"), "comision")
        .when(d.rlike("(interes|interés)"), "interes")
        .when(minor > 0, "ingreso")
        .otherwise("gasto")
    )


def cash_flow(minor: Column, native: Column, inverted: Column) -> Column:
    """Amounts of natively signed card statements turned into cash flow."""
    return F.when(native & inverted, -minor).otherwise(minor)


def estimate_minor(raw: Column) -> Column:
    """The largest printed amount of a raw line, for reports on unreadable rows only."""
    found = F.regexp_extract_all(raw, F.lit(r"[0-9][0-9,]*\.[0-9]{2}"), F.lit(0))
    return F.array_max(F.transform(found, lambda x: F.regexp_replace(x, "[,.]", "").cast("decimal(30,0)"))).cast("long")


def try_long(text: Column) -> Column:
    return text.try_cast("long")
