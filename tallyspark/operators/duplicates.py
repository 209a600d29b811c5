"""Duplicate movements across statements, and corrected re-issues of a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import periods_overlap
from ..session import durable, spread_join


def find_duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``(transaction_id, dup_of, reason, suspicious)`` for new rows whose fingerprint is known from another statement.

    Both tables have ``transaction_id, statement_id, fingerprint, bank_ref,
    period_start, period_end``.  A candidate counts if references are equal or
    periods overlap; the k-th equal new row takes the k-th prior row, so a genuine
    repetition is not swallowed.  Without such a candidate the row is suspicious.
    """
    # equal rows of a statement are told apart by their number
    numbered = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy("statement_id", "fingerprint").orderBy("transaction_id")))
    old = numbered(existing).select(*[F.col(c).alias(f"old_{c}") for c in ("transaction_id", "statement_id", "bank_ref", "period_start", "period_end")], "fingerprint", "_k")
    pairs = numbered(new).join(old, ["fingerprint", "_k"]).where("statement_id <> old_statement_id")
    same_ref = F.coalesce((F.col("bank_ref") == F.col("old_bank_ref")) & (F.col("bank_ref") != ""), F.lit(False))
    overlap = periods_overlap(F.col("period_start"), F.col("period_end"), F.col("old_period_start"), F.col("old_period_end"))
    reason = F.when(same_ref, "mismo bank_ref").when(overlap, "misma huella en periodos solapados")
    found = pairs.select("transaction_id", F.when(reason.isNotNull(), F.struct("old_transaction_id", reason.alias("reason"))).alias("hit"))
    best = found.groupBy("transaction_id").agg(F.min("hit").alias("hit"))
    return best.select("transaction_id", F.col("hit.old_transaction_id").alias("dup_of"), F.col("hit.reason").alias("reason"), F.col("hit").isNull().alias("suspicious"))


_KEY = ["account_id", "date_op", "description_norm"]
_CLASS = [*_KEY, "statement_id", "fingerprint", "_ref", "period_start", "period_end"]


def _classes(rows: DataFrame) -> DataFrame:
    """Rows that can be or have a prior version, with ``_class``, all that decides about them."""
    whole = rows.where("account_id IS NOT NULL AND date_op IS NOT NULL AND description_norm <> '' AND statement_id IS NOT NULL AND fingerprint IS NOT NULL AND period_start <= period_end")
    return whole.withColumn("_ref", F.coalesce(F.trim("bank_ref"), F.lit(""))).withColumn("_class", F.struct(*_CLASS))


def _groups(asked: bool) -> Column:
    """The groups that a class is counted in (or, ``asked``, that are counted for it), and with which sign.

    References agree if they are equal or one is blank: who has none is compared
    with all, who has one with those without and with its own.  Of these, rows of
    the own statement and of the own fingerprint are taken off, and those of both,
    taken off twice, added again.
    """
    blank = F.col("_class._ref") == ""
    mine = F.when(blank, F.lit("none")).otherwise(F.concat(F.lit("="), "_class._ref"))
    refs = F.when(blank, F.array(F.lit("all"))).otherwise(F.array(F.lit("none"), mine)) if asked else F.array(F.lit("all"), mine)
    any_, st, fp = F.lit("any"), F.concat(F.lit("="), F.col("_class.statement_id").cast("string")), F.concat(F.lit("="), F.col("_class.fingerprint").cast("string"))
    signs = F.array(*[F.struct(a.alias("statement"), b.alias("print"), F.lit(sign).alias("sign")) for a, b, sign in ((any_, any_, 1), (st, any_, -1), (any_, fp, -1), (st, fp, 1))])
    key = [F.col(f"_class.{c}").alias(c) for c in _KEY]
    return F.explode(F.flatten(F.transform(refs, lambda r: F.transform(signs, lambda s: F.struct(F.struct(*key, r.alias("ref"), s["statement"].alias("statement"), s["print"].alias("print")).alias("group"), s["sign"].alias("sign"))))))


def _overlapping(asked: DataFrame, old: DataFrame) -> DataFrame:
    """``(at, weight, n, ids)`` for each distinct ``at = (group, period_start, period_end)`` that is asked for: how many old rows of the
    group have a period that overlaps, and the sum of their ids' hashes.

    All that began by the period's end, less those that ended before its start:
    running sums over the days of a group, of which each is one row.
    """
    period = lambda day, ord_, n, ids, ended: F.struct(day.alias("day"), F.lit(ord_).alias("ord"), *[(v if take else v * 0).alias(c) for take, v, c in ((not ended, n, "began"), (not ended, ids, "began_ids"), (ended, n, "ended"), (ended, ids, "ended_ids"))])
    n, ids = F.col("n"), F.col("ids")
    days = old.select("group", F.explode(F.array(period(F.col("start"), 1, n, ids, False), period(F.col("end"), 1, n, ids, True))).alias("p")).select("group", "p.*")
    running = ["began", "began_ids", "ended", "ended_ids"]
    days = days.groupBy("group", "day", "ord").agg(*[F.sum(c).alias(c) for c in running])
    ask = asked.groupBy("at").agg(F.count(F.lit(1)).alias("weight"))
    points = ask.select("at", "weight", F.col("at.group").alias("group"), F.explode(F.array(F.struct(F.col("at.end").alias("day"), F.lit(2).alias("ord")), F.struct(F.col("at.start").alias("day"), F.lit(0).alias("ord")))).alias("p")).select("at", "weight", "group", "p.*")
    so_far = Window.partitionBy("group").orderBy("day", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = days.unionByName(points, allowMissingColumns=True).select("at", "weight", "ord", *[F.sum(c).over(so_far).alias(c) for c in running]).where("at IS NOT NULL")
    least = lambda a, b: F.sum(F.when(F.col("ord") == 2, F.coalesce(a, F.lit(0))).otherwise(-F.coalesce(b, F.lit(0))))
    return told.groupBy("at").agg(F.max("weight").alias("weight"), least("began", "ended").alias("n"), least("began_ids", "ended_ids").alias("ids"))


#: Old classes of one account, day and description that are compared one by one; beyond that they are counted.
FEW = 16


def _counted(mine: DataFrame, held: DataFrame) -> DataFrame:
    """``(_class, n, ids)`` of classes with candidates, by running sums; for keys with any number of classes."""
    counted = held.select(_groups(False).alias("g"), F.col("_class.period_start").alias("start"), F.col("_class.period_end").alias("end"), "n", "ids").select("g.group", "start", "end", "n", "ids")
    asked = mine.select("_class", _groups(True).alias("g")).select("_class", "g.sign", F.struct("g.group", F.col("_class.period_start").alias("start"), F.col("_class.period_end").alias("end")).alias("at"))
    found = durable(_overlapping(asked.select("at"), counted.groupBy("group", "start", "end").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))))
    return spread_join(asked, found, "at", "weight").groupBy("_class").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("ids")).alias("ids")).where("n > 0")


def _matched(mine: DataFrame, held: DataFrame) -> DataFrame:
    """The same for keys with ``FEW`` old classes at most, which are joined."""
    key = [F.col(f"_class.{c}").alias(c) for c in _KEY]
    pairs = mine.select("_class", *key).join(held.select(*key, F.col("_class").alias("_old"), "n", "ids"), _KEY)
    fits = "_class.statement_id <> _old.statement_id AND _class.fingerprint <> _old.fingerprint AND _old.period_start <= _class.period_end AND _old.period_end >= _class.period_start"
    agree = "_class._ref = '' OR _old._ref = '' OR _class._ref = _old._ref"
    return pairs.where(fits).where(agree).groupBy("_class").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def prior_versions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``(transaction_id, supersedes, ambiguous)``: rows that correct a row of an overlapping statement.

    Same account, date and description, another statement and fingerprint, not
    superseded yet, references equal unless one is blank.  Only a single sibling
    with a single candidate supersedes; anything else is ambiguous.

    Candidates are counted, not listed: equal rows are one class, and classes of a
    key with more than ``FEW`` old ones ask for running sums over days, so neither
    many equal rows nor many classes cost pairs.  Where one candidate is left, the
    sum of hashed ids is its own hash, by which it is fetched.  Rows without
    account, date, description, statement or period, or whose period ends before
    it begins, have and are no candidates.
    """
    rows = _classes(new)
    mine = durable(rows.groupBy("_class").agg(F.count(F.lit(1)).alias("movements")))
    live = existing.where("dup_of IS NULL") if "dup_of" in existing.columns else existing
    wanted = mine.select(*[F.col(f"_class.{c}").alias(c) for c in _KEY]).distinct()
    old = _classes(live).join(wanted, _KEY, "left_semi").select("_class", "transaction_id", F.xxhash64("transaction_id").alias("_hash"))
    held = durable(old.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_hash").cast("decimal(20,0)")).cast("decimal(38,0)").alias("ids")))
    key = [F.col(f"_class.{c}").alias(c) for c in _KEY]
    crowded = durable(held.select(*key).groupBy(*_KEY).count().where(F.col("count") > FEW).drop("count"))
    if crowded.isEmpty():
        met = _matched(mine, held)
    else:
        part = lambda df, how: df.select("*", *key).join(crowded, _KEY, how).drop(*_KEY)
        met = _matched(part(mine, "left_anti"), part(held, "left_anti")).unionByName(_counted(part(mine, "left_semi"), part(held, "left_semi")))
    siblings = F.sum("movements").over(Window.partitionBy("_class.statement_id", *[f"_class.{c}" for c in _KEY]))
    judged = mine.withColumn("siblings", siblings).join(met, "_class").withColumn("single", (F.col("n") == 1) & (F.col("siblings") == 1))
    single = judged.where("single").select("_class", F.col("ids").cast("long").alias("_hash"), *[F.col(f"_class.{c}").alias(c) for c in _KEY])
    theirs = old.select(*[F.col(f"_class.{c}").alias(c) for c in _KEY], "_hash", F.col("transaction_id").alias("supersedes"))
    fetched = single.join(theirs, [*_KEY, "_hash"]).groupBy("_class").agg(F.min("supersedes").alias("supersedes"))
    verdict = durable(judged.select("_class", "movements", "single").join(fetched, "_class", "left"))
    return spread_join(rows.select("_class", "transaction_id"), verdict, "_class", "movements").select("transaction_id", "supersedes", (~F.col("single")).alias("ambiguous"))


def not_committed(new: DataFrame, committed: DataFrame, key: str = "statement_id") -> DataFrame:
    """Rows whose statement is not in the store yet: importing twice changes nothing."""
    return new.join(committed.select(key).distinct(), key, "left_anti")


def distinct_contents(statements: DataFrame, rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """One statement of each set with equal period and rows, the first by key."""
    line = F.concat_ws("\x1f", F.col("date_op").cast("string"), F.col("amount_minor").cast("string"), "description_norm")
    content = rows.groupBy(key).agg(F.sha2(F.concat_ws("\x1e", F.array_sort(F.collect_list(line))), 256).alias("_content"))
    whole = statements.join(content, key, "left").withColumn("_content", F.coalesce("_content", F.lit("")))
    first = Window.partitionBy("period_start", "period_end", "_content").orderBy(key)
    return whole.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_content")
