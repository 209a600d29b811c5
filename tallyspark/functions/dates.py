"""Dates as statements print them, to DATE; unreadable ones become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish months by their first three letters.
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12}
#: Days between an operation and the period it is charged in, at most.
MAX_LAG_DAYS = 45

_DMY = r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})$"
_NAMED = r"^([0-9]{1,2})[\s\-/]*([a-záéíóú]{3,})[\s\-/]*([0-9]{2,4})?$"


def month_number(name: Column) -> Column:
    """1 to 12 for a Spanish month or anything that begins like one, else null."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return table[F.substring(F.lower(name), 1, 3)]


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A calendar date or null; two-digit years are of this century."""
    full = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(full >= 1, F.try_to_date(F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))


def normalize_date(text: Column, year_hint: Column | None = None) -> Column:
    """ISO dates, day/month/year (swapped only if it can't be otherwise) and day month-name [year]."""
    s = F.lower(F.regexp_replace(text.cast("string"), r"(?U)^\s+|\s+$", ""))
    part = lambda pattern, k: F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).cast("int")
    d, m, y = (part(_DMY, k) for k in (1, 2, 3))
    swapped = (m > 12) & (d <= 12)
    by_number = make_date(y, F.when(swapped, d).otherwise(m), F.when(swapped, m).otherwise(d))
    hint = year_hint if year_hint is not None else F.lit(None).cast("int")
    by_name = make_date(F.coalesce(part(_NAMED, 3), hint), month_number(F.regexp_extract(s, _NAMED, 2)), part(_NAMED, 1))
    iso = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~s.startswith("0000"), F.try_to_date(s, "yyyy-MM-dd"))
    return F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso).when(s.rlike(_DMY), by_number).when(s.rlike(_NAMED), by_name)


def period_distance(day: Column, start: Column, end: Column) -> Column:
    """Days outside a period, 0 inside."""
    return F.greatest(F.datediff(start, day), F.datediff(day, end), F.lit(0))


def resolve_year(day: Column, raw: Column, start: Column, end: Column) -> Column:
    """The year of a date printed without one: the first of same, previous and next year inside the period, else the nearest if near enough."""
    shifted = lambda n: F.try_to_date(F.concat(F.lpad((F.year(day) + n).cast("string"), 4, "0"), F.date_format(day, "-MM-dd")), "yyyy-MM-dd")
    choice = lambda k, c: F.struct(period_distance(c, start, end).alias("away"), F.lit(k).alias("turn"), c.alias("day"))
    options = F.filter(F.array(choice(0, day), choice(1, shifted(-1)), choice(2, shifted(1))), lambda x: x["day"].isNotNull())
    best = F.array_min(options)
    fixed = day.isNull() | start.isNull() | end.isNull() | F.coalesce(raw, F.lit("")).rlike("[0-9]{4}")
    return F.when(fixed, day).when(best["away"] <= MAX_LAG_DAYS, best["day"]).otherwise(day)


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def periods_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two periods share a day; false if a bound is unknown."""
    return F.coalesce((s1 <= e2) & (s2 <= e1), F.lit(False))


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))
