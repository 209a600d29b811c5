"""Text lines of documents, and the period a document covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import normalize_date
from ..grammars import patterns as P
from ..session import computed

_FORMS = (("range", P.PERIOD_RANGE, (1, 2)), ("days", P.PERIOD_DAYS, (1, 2, 3, 4)), ("cut", P.CUT_DATE, (1,)), ("count", P.DAY_COUNT, (1,)), ("month", P.PERIOD_MONTH, (1, 2, 3)))


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, line)``, from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_no"), "line")


def with_period(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``period_start`` and ``period_end`` by the first of: two dates behind the label of a period or statement, days of
    one month, a cut-off date and a number of days (20 to 40), a month of exactly that many days.

    A form that is found but can't be read gives nulls; the others are not tried then.
    """
    out = rows.withColumns({f"_{name}{k}": F.regexp_extract(F.coalesce(text, F.lit("")), rx, k) for name, rx, groups in _FORMS for k in groups})
    c, out = F.col, computed(out)
    span = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    day = lambda d, form: F.concat_ws(" ", d, c(f"_{form}{3 if form == 'days' else 1}"), c(f"_{form}{4 if form == 'days' else 2}"))
    # only the dates of the form that counts are read: two spans share their columns, and so do a cut-off date and a month
    is_range, is_days = c("_range1") != "", c("_days1") != ""
    first = F.when(is_range, c("_range1")).when(is_days, day(c("_days1"), "days")).otherwise(c("_cut1"))
    second = F.when(is_range, c("_range2")).when(is_days, day(c("_days2"), "days")).otherwise(day(F.lit("1"), "month"))
    out = computed(out.withColumns({"_a": first, "_b": second}))
    out = computed(out.withColumn("_a", normalize_date(c("_a"))))
    out = computed(out.withColumn("_b", normalize_date(c("_b"))))
    n, k = (F.nullif(c(name), F.lit("")).cast("int") for name in ("_count1", "_month3"))
    cut = F.when(c("_a").isNotNull() & n.between(20, 40), span(F.date_sub("_a", n - 1), c("_a")))
    month = F.when(F.dayofmonth(F.last_day("_b")) == k, span(c("_b"), F.last_day("_b")))
    both = F.when(c("_a").isNotNull() & c("_b").isNotNull(), span(c("_a"), c("_b")))
    chosen = F.when(is_range | is_days, both).otherwise(F.coalesce(cut, month))
    out = out.withColumn("_p", chosen).withColumn("period_start", c("_p.s")).withColumn("period_end", c("_p.e"))
    return computed(out.select(*rows.columns, "period_start", "period_end"))
