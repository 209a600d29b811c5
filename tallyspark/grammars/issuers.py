"""Grammars by issuer.

Input: ``(doc_id, line_no, line)`` and a table ``docs`` of ``doc_id, bank, text,
period_start, period_end, opening_minor, closing_minor``.  Output of each grammar:
``doc_id, line_no, date_raw, date_op, date_post, description, detail,
amount_minor, balance_minor, doubtful``.  Amounts are minor units from the start;
dates that can't be read stay null and are flagged later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import make_date, month_number, normalize_date, resolve_year
from ..functions.money import with_parsed_amount
from ..operators.balances import signs_from_balance, solve_segments, with_segments
from ..session import computed
from . import patterns as P
from .registry import COLUMNS, MOVES, parse_registered, read_registered


#: What a line is known by.
_LINE = ("doc_id", "line_no")


def _by_line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def cents(token: Column) -> Column:
    """Minor units of an amount with two decimals; a hyphen or parenthesis in front negates."""
    digits = F.nullif(F.regexp_replace(token, "[^0-9]", ""), F.lit("")).try_cast("long")
    return F.when(F.trim(token).rlike(r"^(\(|-|\$\s?-)"), -digits).otherwise(digits)


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), r"^[ \-·|$]+|[ \-·|$]+$", "")


def _between(line: str, date: str, token: str) -> Column:
    """The text between the date a line begins with and the first place of a token."""
    rest = F.expr(f"substring({line}, length({date}) + 1)")
    at = F.expr(f"instr(substring({line}, length({date}) + 1), {token})")
    return F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest)


def _out(rows: DataFrame, **given: Column) -> DataFrame:
    blank = {"date_post": "date", "detail": "string", "balance_minor": "long"}
    have = {c: given[c] if c in given else F.col(c) if c in rows.columns else F.lit(None).cast(blank.get(c, "string")) for c in COLUMNS}
    have["doubtful"] = given.get("doubtful", F.col("doubtful") if "doubtful" in rows.columns else F.lit(False))
    return rows.select(*[have[c].alias(c) for c in COLUMNS])


def _dated(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that begin with a date; later filters stay above it, so that each line is searched once."""
    rows = computed(lines.withColumn("s", F.trim("line")), *_LINE)
    return computed(rows.withColumn("date_raw", F.regexp_extract("s", pattern, 1)), *_LINE).where("date_raw <> ''")


def _months(start: str, end: str) -> Column:
    """The first days of the months that a period touches."""
    return F.sequence(F.trunc(start, "MM").cast("date"), F.trunc(end, "MM").cast("date"), F.expr("interval 1 month"))


def _named_month(name: Column) -> Column:
    return month_number(F.regexp_replace(name, r"\.", "")).isNotNull()


def rejoin_split_dates(lines: DataFrame) -> DataFrame:
    """Movements whose date is printed over three lines, as one line in the first one's place.

    Either day and month alone, the movement, the year alone; or day, month and
    text, an amount alone, year and more text.  The month has to be a month.
    """
    s = F.trim(F.col("line"))
    near = lines.withColumn("s", s).withColumn("s1", F.lead(s, 1).over(_by_line())).withColumn("s2", F.lead(s, 2).over(_by_line()))
    plain = F.col("s").rlike(P.ONLY_DAY_MONTH) & _named_month(F.regexp_extract("s", P.ONLY_DAY_MONTH, 1)) & F.col("s2").rlike(P.ONLY_YEAR) & F.col("s1").rlike(P.SIGNED) & ~F.col("s1").rlike(P.FULL_DATE)
    rest = F.regexp_extract("s", P.DAY_MONTH_TEXT, 3)
    texted = F.col("s").rlike(P.DAY_MONTH_TEXT) & _named_month(F.regexp_extract("s", P.DAY_MONTH_TEXT, 2)) & ~F.col("s").rlike(P.FULL_DATE) & ~rest.rlike(P.SIGNED) & F.col("s1").rlike(P.SIGNED_ALONE) & F.col("s2").rlike(P.YEAR_TEXT)
    joined = F.when(plain, F.concat_ws(" ", "s", F.col("s2"), F.col("s1"))).when(
        texted, F.concat_ws(" ", F.regexp_extract("s", P.DAY_MONTH_TEXT, 1), F.regexp_extract("s2", P.YEAR_TEXT, 1), rest, F.nullif(F.regexp_extract("s2", P.YEAR_TEXT, 2), F.lit("")), F.col("s1")))
    near = computed(near.select(*_LINE, "line", joined.alias("joined")), *_LINE)
    near = near.withColumn("_kept", F.col("joined").isNotNull())  # neither an amount nor a year begins another triple, so none overlap
    eaten = F.coalesce(F.lag("_kept", 1).over(_by_line()), F.lit(False)) | F.coalesce(F.lag("_kept", 2).over(_by_line()), F.lit(False))
    near = near.withColumn("_eaten", eaten & ~F.col("_kept"))
    return near.where("NOT _eaten").select("doc_id", "line_no", F.when(F.col("_kept"), F.col("joined")).otherwise(F.col("line")).alias("line"))


def signed(lines: DataFrame) -> DataFrame:
    """Explicit signs: the last signed amount of a dated line, or one that stands alone on the line before."""
    lines = rejoin_split_dates(lines)
    text = F.when(F.trim("line") != "", F.trim("line"))
    before = F.last(text, ignorenulls=True).over(_by_line().rowsBetween(Window.unboundedPreceding, -1))
    rows = _dated(lines.withColumn("_above", F.lag("line").over(_by_line())).withColumn("_before", before), P.FULL_DATE)
    rows = computed(rows.withColumn("_all", F.regexp_extract_all("s", F.lit(P.SIGNED), F.lit(0))), *_LINE)
    alone = F.when(F.col("_above").rlike(P.SIGNED_ALONE), F.trim("_above"))
    rows = rows.withColumn("_token", F.when(F.size("_all") > 0, F.element_at("_all", -1)).otherwise(alone)).where("_token IS NOT NULL")
    rows = rows.withColumn("_first", F.when(F.size("_all") > 0, F.col("_all")[0]).otherwise(F.lit("\x00")))
    said = F.regexp_replace(_between("s", "date_raw", "_first"), P.SECOND_DATE, "")
    said = _clean(F.regexp_replace(said, P.TAX_SUFFIX, ""))
    loose = F.when(~F.col("_before").rlike(P.FULL_DATE) & ~F.col("_before").rlike(P.SIGNED) & ~F.col("_before").rlike(P.TABLE_HEADER), F.col("_before"))
    rows = computed(rows.withColumn("description", F.coalesce(F.nullif(said, F.lit("")), loose, F.lit(""))), *_LINE)
    rows = rows.where(~F.col("description").rlike(P.NOT_A_MOVEMENT))
    return _out(rows, date_op=normalize_date(F.regexp_replace("date_raw", r"\.", "")), amount_minor=cents(F.regexp_replace("_token", r"\s", "")))


def legacy_card(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The older card layout: no year, no sign; payments reduce the debt, what can't be told is doubtful, and so is all if payments differ from the declared total."""
    rows = lines.withColumn("s", F.trim("line")).where(F.col("s").rlike(P.LEGACY_LINE))
    rows = rows.withColumn("date_raw", F.regexp_extract("s", P.LEGACY_LINE, 1)).withColumn("description", _clean(F.regexp_extract("s", P.LEGACY_LINE, 2)))
    rows = rows.where(~F.col("description").rlike(P.LEGACY_EXCLUDED))
    paid = F.col("description").rlike(P.LEGACY_PAYMENT)
    minus = (F.regexp_extract("s", P.LEGACY_LINE, 3) != "") | paid
    size = cents(F.regexp_extract("s", P.LEGACY_LINE, 4))
    declared = docs.select("doc_id", "period_start", "period_end", cents(F.regexp_extract("text", P.LEGACY_TOTAL, 1)).alias("_declared"))
    rows = rows.join(declared, "doc_id").withColumn("amount_minor", F.when(minus, -size).otherwise(size)).withColumn("_paid", F.when(paid, size).otherwise(0))
    off = F.coalesce(F.sum("_paid").over(Window.partitionBy("doc_id")) != F.col("_declared"), F.lit(False))
    doubtful = (~minus & F.col("description").rlike(P.LEGACY_AMBIGUOUS)) | off
    rows = computed(rows.withColumn("doubtful", doubtful).withColumn("_day", normalize_date(F.col("date_raw"), F.year("period_end"))))
    return _out(rows, date_op=resolve_year(F.col("_day"), F.col("date_raw"), F.col("period_start"), F.col("period_end")))


def balance_column(lines: DataFrame, docs: DataFrame, dates: Column | None = None) -> DataFrame:
    """Unsigned amount and balance at the end of a dated line: the balance's change gives the sign and checks the amount."""
    rows = computed(_dated(lines.select("doc_id", "line_no", "line"), P.ANY_DATE).withColumn("_all", F.regexp_extract_all("s", F.lit(P.AMOUNT), F.lit(0))), *_LINE).where(F.size("_all") >= 2)
    rows = rows.withColumn("balance_minor", cents(F.element_at("_all", -1))).withColumn("magnitude_minor", F.abs(cents(F.element_at("_all", -2)))).withColumn("_first", F.col("_all")[0])
    rows = rows.withColumn("description", _clean(_between("s", "date_raw", "_first")))
    rows = rows.join(docs.select("doc_id", "opening_minor", "period_start", "period_end"), "doc_id")
    done = signs_from_balance(rows, "doc_id", ["line_no"])
    done = computed(done.withColumn("_day", normalize_date(F.regexp_replace("date_raw", r"\.", ""), F.year("period_end"))), *_LINE)
    return _out(done, date_op=resolve_year(F.col("_day"), F.col("date_raw"), F.col("period_start"), F.col("period_end")))


def day_column(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Only the day is printed and thousands are set off by spaces: the day becomes a date if the period has one such day, then as ``balance_column``."""
    period = docs.select("doc_id", F.col("period_start").alias("_ps"), F.col("period_end").alias("_pe")).where("_ps <= _pe")
    amounts = F.regexp_extract_all("line", F.lit(P.SPACED_AMOUNT), F.lit(0))
    mended = F.aggregate(amounts, F.col("line"), lambda text, a: F.replace(text, a, F.regexp_replace(F.translate(a, " ", ","), r"^\$,", "\\$ ")))
    rows = computed(lines.select(*_LINE, mended.alias("line")), *_LINE)
    day = F.nullif(F.regexp_extract("line", P.LONE_DAY, 1), F.lit("")).cast("int")
    rows = computed(rows.withColumn("_day", day).withColumn("_many", F.size(F.regexp_extract_all("line", F.lit(P.AMOUNT), F.lit(0))) >= 2), *_LINE).join(period, "doc_id")
    fits = F.filter(F.transform(_months("_ps", "_pe"), lambda m: F.when(F.col("_day").between(1, F.dayofmonth(F.last_day(m))), F.date_add(m, F.col("_day") - 1))), lambda d: d.between(F.col("_ps"), F.col("_pe")))
    rows = computed(rows.withColumn("_fits", F.when(F.col("_day").isNotNull() & F.col("_many"), fits)), *_LINE)
    rest = F.expr("substring(line, length(regexp_extract(line, '^\\\\s*[0-9]{1,2}', 0)) + 1)")
    dated = F.when(F.size("_fits") == 1, F.concat(F.date_format(F.col("_fits")[0], "yyyy-MM-dd"), rest)).when(F.size("_fits") != 1, F.concat(F.lit("00-00-00"), rest)).otherwise(F.col("line"))
    return balance_column(rows.select("doc_id", "line_no", dated.alias("line")), docs)


def segments(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Debit account: amount first, running balance on some lines; signs solve each stretch between balances, undated lines below are detail."""
    rows = computed(lines.select(*_LINE, F.trim("line").alias("s")), *_LINE)
    rows = computed(rows.withColumn("date_raw", F.regexp_extract("s", P.DAY_MONTH, 1)).withColumn("_all", F.regexp_extract_all("s", F.lit(P.AMOUNT), F.lit(0))), *_LINE)
    moves = (F.col("date_raw") != "") & (F.size("_all") > 0)
    rows = rows.withColumn("_move", moves).withColumn("_stop", ~F.col("_move") & F.col("s").rlike(P.TABLE_END))
    group = F.count(F.when(F.col("_move") | F.col("_stop"), 1)).over(_by_line())
    rows = rows.withColumn("_g", group).withColumn("_open", F.max(F.col("_move").cast("int")).over(Window.partitionBy("doc_id", "_g")))
    below = rows.where("NOT _move AND NOT _stop AND _open = 1 AND s <> ''").where(~F.col("s").rlike(P.PAGE_FURNITURE))
    detail = below.groupBy("doc_id", "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), " | ").alias("detail"))
    m = rows.where("_move").withColumn("magnitude_minor", F.abs(cents(F.col("_all")[0]))).withColumn("balance_minor", F.when(F.size("_all") >= 3, cents(F.element_at("_all", -2)))).withColumn("_first", F.col("_all")[0])
    second = P.SECOND_DAY_MONTH
    said = _between("s", "date_raw", "_first")
    m = m.withColumn("_liq", F.regexp_extract(F.expr("substring(s, length(date_raw) + 1)"), second, 1)).withColumn("description", _clean(F.regexp_replace(said, second, "")))
    m = m.join(docs.select("doc_id", "period_start", "period_end", "opening_minor", "closing_minor"), "doc_id").withColumn("_guess", F.when(F.col("description").rlike(P.CREDIT_WORDS), 1).otherwise(-1))
    m = with_segments(m, "doc_id", ["line_no"], closing="closing_minor")
    signs = solve_segments(m, "doc_id", "line_no", guess="_guess").select("doc_id", "line_no", "sign")
    m = m.join(signs, ["doc_id", "line_no"]).join(detail, ["doc_id", "_g"], "left")
    sign = F.when(F.col("net_minor").isNull(), F.col("_guess")).otherwise(F.col("sign"))
    iso = lambda raw: _day_in_period(F.col(raw), F.col("period_start"), F.col("period_end"))
    return _out(m, date_op=iso("date_raw"), date_post=iso("_liq"), detail=F.coalesce("detail", F.lit("")), amount_minor=F.when(sign != 0, sign * F.col("magnitude_minor")).otherwise(F.col("magnitude_minor")), doubtful=sign == 0)


def _day_in_period(raw: Column, start: Column, end: Column) -> Column:
    """``DD/MMM`` in the year, of the period's start or end, that is inside or nearest, within the lag; with a year as printed."""
    part = lambda k: F.nullif(F.regexp_extract(raw, P.DAY_MONTH_PARTS, k), F.lit(""))
    day, month, year = part(1).cast("int"), month_number(part(2)), part(3).cast("int")
    away = lambda d: F.greatest(F.datediff(start, d), F.datediff(d, end), F.lit(0))
    options = F.transform(F.array(F.year(start), F.year(end)), lambda y: make_date(y, month, day))
    ranked = F.filter(F.transform(options, lambda d: F.struct(away(d).alias("away"), d.alias("d"))), lambda x: x["d"].isNotNull() & (x["away"] <= 45))
    return F.when(year.isNotNull(), make_date(year, month, day)).otherwise(F.array_min(ranked)["d"])


def two_dates(lines: DataFrame) -> DataFrame:
    """Credit card with operation and charge dates and native signs; card number and dollar lines go to the detail."""
    rows = lines.withColumn("s", F.trim("line")).withColumn("_move", F.col("s").rlike(P.CARD_LINE)).withColumn("_usd", F.regexp_extract("s", P.CARD_DOLLARS, 1)).where("_move OR _usd <> ''")
    rows = rows.withColumn("_g", F.count(F.when(F.col("_move"), 1)).over(_by_line()))
    usd = rows.where("NOT _move").groupBy("doc_id", "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_usd"))), lambda x: x["_usd"]), " | ").alias("_dollars"))
    m = rows.where("_move").join(usd, ["doc_id", "_g"], "left")
    g = lambda k: F.regexp_extract("s", P.CARD_LINE, k)
    m = m.withColumn("date_raw", g(1)).withColumn("_said", F.trim(g(3))).withColumn("_card", F.nullif(F.regexp_extract("_said", P.CARD_NUMBER, 1), F.lit("")))
    size = cents(g(5))
    return _out(m, date_op=normalize_date(g(1)), date_post=normalize_date(g(2)), description=F.regexp_replace(F.regexp_replace("_said", P.CARD_NUMBER, ""), "^[ ;]+|[ ;]+$", ""), detail=F.concat_ws(" | ", "_card", "_dollars"), amount_minor=F.when(g(4) == "+", size).otherwise(-size))


def charges(lines: DataFrame) -> DataFrame:
    """Revolving card: charges raise the debt, payments and refunds lower it; a late-payment fee is a charge."""
    rows = _dated(lines, P.CARD_DATE).withColumn("_all", F.regexp_extract_all("s", F.lit(P.AMOUNT), F.lit(0)))
    rows = computed(rows, *_LINE).where(F.size("_all") > 0).withColumn("_first", F.col("_all")[0])
    minus = F.trim("_first").rlike(r"^[(-]") | (F.col("s").rlike(P.PAYMENT_WORDS) & ~F.col("s").rlike(P.LATE_FEE))
    size = F.abs(cents(F.col("_first")))
    return _out(rows, date_op=normalize_date(F.regexp_replace("date_raw", r"\.", "")), description=_clean(_between("s", "date_raw", "_first")), amount_minor=F.when(minus, -size).otherwise(size))


def generic(lines: DataFrame) -> DataFrame:
    """Date, text and amount of a line, whoever printed it; an ambiguous amount stays null."""
    rows = lines.where(F.col("line").rlike(P.GENERIC_LINE)).select("doc_id", "line_no", *[F.regexp_extract("line", P.GENERIC_LINE, k).alias(n) for k, n in ((1, "_date"), (2, "_text"), (3, "_amount"))])
    rows = computed(with_parsed_amount(rows, "_amount", F.lit("MXN"), "amount_minor"))
    raw = F.trim("_date")
    return _out(rows, date_raw=raw, date_op=normalize_date(F.regexp_replace(raw, r"\.$", "")), description=F.trim("_text"))


def generic_balances(docs: DataFrame) -> DataFrame:
    """Adds ``opening_raw`` and ``closing_raw`` as documents of unknown issuers print them."""
    found = lambda rx: F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), rx, 1)), F.lit(""))
    return docs.withColumn("opening_raw", found(P.GENERIC_OPENING)).withColumn("closing_raw", found(P.GENERIC_CLOSING))


_BUILT_IN = ("nu", "uala", "gbm", "hsbc", "vexi", "bbva")


def _unregistered(docs: DataFrame, grammars: dict[str, str] | None) -> DataFrame:
    """Without the documents that only registered grammars read."""
    own = [b for b in grammars or () if b not in _BUILT_IN]
    return docs.where(F.col("bank").isNull() | ~F.col("bank").isin(own)) if own else docs


def warnings(lines: DataFrame, docs: DataFrame, grammars: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, line_no, warning)``: lines that look like movements but give none, or that were read with help.

    Nothing is left out in silence: excluded labels, amounts taken from the line
    before, dated lines without an amount and a balance, days that do not tell
    their date, dated lines of unknown issuers, and payments that differ from the
    declared total (without a line number).
    """
    given, docs = docs, computed(_unregistered(docs, grammars))
    rows = lines.join(docs.select("doc_id", "bank", "period_start", "period_end"), "doc_id").withColumn("s", F.trim("line"))
    n_amounts = F.size(F.regexp_extract_all("s", F.lit(P.AMOUNT), F.lit(0)))
    above = F.lag("line").over(_by_line())
    is_signed, c = F.col("bank").isin("nu", "uala"), F.col
    lone = F.nullif(F.regexp_extract("line", P.LONE_DAY, 1), F.lit("")).cast("int")
    days = F.size(F.filter(F.sequence("period_start", "period_end"), lambda d: F.dayofmonth(d) == c("_lone")))
    rows = rows.withColumn("_above", above).withColumn("_lone", F.when(c("bank") == "hsbc", lone)).withColumn("_n", n_amounts)
    kind = (
        F.when((c("bank") == "nu") & c("s").rlike(P.LEGACY_LINE) & c("s").rlike(P.LEGACY_EXCLUDED), "excluded by its label")
        .when(is_signed & (c("s").rlike(P.SIGNED)) & c("s").rlike(P.NOT_A_MOVEMENT), "excluded by its label")
        .when(is_signed & c("s").rlike(P.FULL_DATE) & ~c("s").rlike(P.SIGNED) & c("_above").rlike(P.SIGNED_ALONE), "amount taken from the line before")
        .when((c("bank") == "gbm") & c("s").rlike(P.ANY_DATE) & (c("_n") == 1), "dated line without amount and balance")
        .when(c("_lone").isNotNull() & (c("_n") == 1), "dated line without amount and balance")
        .when(c("_lone").isNotNull() & (c("_n") >= 2) & (c("period_start") <= c("period_end")) & (days != 1), "day does not tell its date")
        .when(c("bank").isNull() & ~c("line").rlike(P.GENERIC_LINE) & c("line").rlike(P.GENERIC_DATED), "dated line not understood")
    )
    by_line = rows.select("doc_id", "line_no", kind.alias("warning")).where("warning IS NOT NULL")
    paid = rows.where((c("bank") == "nu") & c("s").rlike(P.LEGACY_LINE) & c("s").rlike(P.LEGACY_PAYMENT) & ~c("s").rlike(P.LEGACY_EXCLUDED)).groupBy("doc_id").agg(F.sum(cents(F.regexp_extract("s", P.LEGACY_LINE, 4))).alias("_paid"))
    declared = docs.where("bank = 'nu'").select("doc_id", cents(F.regexp_extract("text", P.LEGACY_TOTAL, 1)).alias("_declared"))
    off = declared.join(paid, "doc_id").where("_declared <> _paid").select("doc_id", F.lit(None).cast("int").alias("line_no"), F.lit("payments differ from the declared total").alias("warning"))
    told = by_line.unionByName(off)
    return told.unionByName(parse_registered(lines, given, grammars)[1]) if grammars else told


def _dealt(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Lines with what decides about their grammar, shuffled once: the grammars' conditions stay above, so they all read the same exchange."""
    rows = computed(lines.select(*_LINE, "line").join(docs.select("doc_id", "bank", "_card").distinct(), "doc_id"))
    return computed(rows.where("doc_id IS NOT NULL").repartition("doc_id"), "doc_id")


def parse_lines(lines: DataFrame, docs: DataFrame, grammars: dict[str, str] | None = None) -> DataFrame:
    """Movements of all documents, each by its bank's grammar; those of unknown banks by the generic one.

    ``grammars`` names the registered table functions of further issuers.

    The older card layout is tried for documents of its issuer, or of none, in
    which the signed or the generic grammar finds nothing.
    """
    given, docs = docs, computed(_unregistered(docs, grammars))
    tagged = docs.withColumn("_card", F.coalesce(F.col("text").rlike(P.CARD_LAYOUT), F.lit(False)))
    dealt = _dealt(lines, tagged)
    of = lambda condition: dealt.where(condition).select(*_LINE, "line")
    explicit, loose = signed(of("bank IN ('nu', 'uala')")), generic(of("bank IS NULL"))
    found = signed(of("bank = 'nu'")).select("doc_id").union(loose.select("doc_id")).distinct()
    silent = tagged.where("bank = 'nu' OR bank IS NULL").join(found, "doc_id", "left_anti")
    older = legacy_card(of("bank = 'nu' OR bank IS NULL").join(silent.select("doc_id"), "doc_id", "left_semi"), silent)
    parts = [explicit, loose, older, balance_column(of("bank = 'gbm'"), docs), day_column(of("bank = 'hsbc'"), docs), charges(of("bank = 'vexi'")), segments(of("bank = 'bbva' AND NOT _card"), docs), two_dates(of("bank = 'bbva' AND _card"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(parse_registered(lines, given, grammars)[0]) if grammars else out


def read_lines(lines: DataFrame, docs: DataFrame, grammars: dict[str, str]) -> DataFrame:
    """``parse_lines`` and ``warnings`` as one table, the columns of movements and ``warning``: registered grammars read their documents once for both."""
    rest = _unregistered(docs, grammars)
    blank = lambda c: F.lit(None).cast("date" if c.startswith("date_") and c != "date_raw" else "long" if c.endswith("_minor") else "boolean" if c == "doubtful" else "string")
    said = lambda own: [F.col(c) if c in ("doc_id", "line_no") else blank(c) for c in own]
    moved = parse_lines(lines, rest).withColumn("warning", F.lit(None).cast("string"))
    warned = warnings(lines, rest).select(*[c.alias(n) for n, c in zip(COLUMNS, said(COLUMNS))], "warning")
    movement = F.when(F.expr(MOVES), F.struct(*COLUMNS, F.lit(None).cast("string").alias("warning")))
    warning = F.when(F.col("warning").isNotNull(), F.struct(*[c.alias(n) for n, c in zip(COLUMNS, said(COLUMNS))], "warning"))
    own = read_registered(lines, docs, grammars).select(F.inline(F.array_compact(F.array(movement, warning))))
    return moved.unionByName(warned).unionByName(own)


def summaries(docs: DataFrame) -> DataFrame:
    """Adds what a document declares in its summary: balances in minor units, credits, debits and their number, where printed."""
    pick = lambda kind: F.coalesce(*[F.when(F.col("bank") == bank, F.nullif(F.regexp_extract("text", rx, 1), F.lit(""))) for bank, kinds in P.SUMMARY.items() for rx in kinds[kind]])
    bbva = F.col("bank") == "bbva"
    part = lambda rx, k: F.when(bbva, F.nullif(F.regexp_extract("text", rx, k), F.lit("")))
    out = docs.withColumn("summary_opening", cents(F.regexp_replace(pick("opening"), r"\s", ""))).withColumn("summary_closing", cents(F.regexp_replace(pick("closing"), r"\s", "")))
    out = out.withColumn("declared_credits", cents(part(P.TOTAL_CREDITS, 2))).withColumn("declared_debits", -F.abs(cents(part(P.TOTAL_DEBITS, 2))))
    return computed(out.withColumn("declared_count", part(P.TOTAL_CREDITS, 1).cast("long") + part(P.TOTAL_DEBITS, 1).cast("long")))


def summary_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Yields that one issuer credits without listing them, dated at the period's end; not for card statements, known concepts or without a period."""
    found = docs.where((F.col("bank") == "nu") & F.col("period_end").isNotNull() & ~F.coalesce(F.col("text").rlike(P.CARD_STATEMENT), F.lit(False)))
    found = found.withColumn("description", F.lit("Dinero generado este mes")).withColumn("amount_minor", F.abs(cents(F.nullif(F.regexp_extract("text", P.YIELD, 2), F.lit("")))))
    found = computed(found).where("amount_minor > 0")
    listed = rows.where(F.lower("description").contains("dinero generado")).select("doc_id").distinct()
    found = found.join(listed, "doc_id", "left_anti")
    return _out(found, line_no=F.lit(None).cast("int"), date_raw=F.date_format("period_end", "yyyy-MM-dd"), date_op=F.col("period_end"))
