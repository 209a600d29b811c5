"""Candidates counted without pairs, against plain Python over all pairs."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import duplicates, transfers

DAY0 = dt.date(2026, 1, 1)
MOVEMENT = "transaction_id string, account_id string, date_op date, amount_minor long, currency string, is_new boolean"


def day(k):
    return DAY0 + dt.timedelta(days=k)


def random_movements(seed, n, amounts, accounts, days):
    rng = random.Random(seed)
    rows = [(f"t{k:04d}", rng.choice(accounts), day(rng.randrange(days)), rng.choice([-1, 1]) * rng.choice(amounts), rng.choice(["MXN", None, "USD"]), rng.random() < 0.6) for k in range(n)]
    return rows + [("odd1", None, day(1), 100, "MXN", True), ("odd2", "A", None, 100, "MXN", True), ("odd3", "A", day(1), None, "MXN", True), ("odd4", "A", day(1), 0, "MXN", True)]


def all_pairs(rows, window):
    whole = [r for r in rows if None not in (r[1], r[2], r[3]) and r[3]]
    fits = lambda d, c: d[3] == -c[3] and (d[4] or "MXN") == (c[4] or "MXN") and d[1] != c[1] and abs((d[2] - c[2]).days) <= window and (d[5] or c[5])
    return whole, [(d, c) for d in whole for c in whole if d[3] < 0 < c[3] and fits(d, c)]


@pytest.mark.parametrize(("seed", "n", "amounts", "accounts", "days", "window"), [(1, 300, [100], "AB", 12, 3), (2, 250, [100, 200, 300], "ABCD", 40, 0), (3, 200, list(range(100, 160)), "ABC", 30, 5), (4, 60, [7], "ABCDEFG", 200, 3)])
def test_partners_and_sole_pairs_against_all_pairs(spark, seed, n, amounts, accounts, days, window):
    rows = random_movements(seed, n, amounts, accounts, days)
    whole, pairs = all_pairs(rows, window)
    degree = Counter(x[0] for p in pairs for x in p)
    df = spark.createDataFrame(rows, MOVEMENT)
    classes = transfers.partner_classes(df, window).collect()
    assert sum(r["movements"] for r in classes) == len(whole)
    got = {(r["amount_minor"], r["currency"], r["account_id"], r["date_op"], r["is_new"]): r["partners"] for r in classes}
    assert all(got[r[3], r[4] or "MXN", r[1], r[2], r[5]] == degree[r[0]] for r in whole)
    want = {(d[0], c[0], c[3], c[4] or "MXN") for d, c in pairs if degree[d[0]] == 1 and degree[c[0]] == 1}
    assert {tuple(r) for r in transfers.sole_pairs(df, window).collect()} == want
    assert want or seed in (1,)


def test_an_amount_with_a_million_movements_costs_no_pairs(spark):
    k = F.col("id")
    crowd = spark.range(1_000_000).select(F.concat(F.lit("t"), k).alias("transaction_id"), F.concat(F.lit("a"), k % 1000).alias("account_id"), F.date_add(F.lit(DAY0), (k % 10).cast("int")).alias("date_op"), F.when((k / 1000).cast("long") % 2 == 0, 500).otherwise(-500).cast("long").alias("amount_minor"))
    lone = spark.createDataFrame([("x", "a1", day(900), -500), ("y", "b", day(902), 500), ("z", "b", day(905), 500)], "transaction_id string, account_id string, date_op date, amount_minor long")
    rows = crowd.union(lone)
    classes = transfers.partner_classes(rows)
    total = classes.agg(F.sum("movements"), F.sum(F.col("movements") * F.col("partners")), F.count(F.lit(1))).first()
    per_day = 50_000  # of each sign, 100 accounts with 500 each
    near = sum(1 for a in range(10) for b in range(10) if abs(a - b) <= 3)
    # an account's movements all fall on one day
    assert total[0] == 1_000_003 and total[1] == 2 * (near * per_day * per_day - 10 * 100 * 500 * 500) + 2 and total[2] == 2003
    assert [tuple(r)[:3] for r in transfers.sole_pairs(rows).collect()] == [("x", "y", 500)]


def test_reviews_name_the_amounts_beyond_the_cap(spark):
    rows = [(f"t{k}", "AB"[k % 2], day(k % 9), (-1) ** k * (500 if k < 12 else 1000 + k // 2), "MXN", k != 3) for k in range(40)]
    df = spark.createDataFrame(rows, MOVEMENT).select("*", F.lit(None).cast("string").alias("bank_ref"), F.lit("x").alias("description_norm"), F.lit("debito").alias("account_type"))
    crowded = {f"t{k}" for k in range(12)} - {"t3"}
    got = {r[0] for r in transfers.transfer_reviews(df, bucket_cap=11).collect()}
    assert crowded <= got and got != crowded
    assert {r["transaction_id"] for r in transfers.within_bucket_cap(df, 11).where("NOT bucket_ok").collect()} == crowded | {"t3"}


def test_tokens_of_many_accounts_meet_only_their_words(spark):
    n = 100_000
    tokens = spark.range(n).select(F.concat(F.lit("acc"), "id").alias("account_id"), F.concat(F.lit("marca"), "id").alias("token"))
    tokens = tokens.union(spark.createDataFrame([("acc1", "grupo del sol"), ("acc2", "nu"), ("acc3", "banco")], "account_id string, token string"))
    texts = spark.createDataFrame([
        ("t1", "Pago MARCA1, gracias", "acc1"), ("t2", "pago marca1", "acc2"), ("t3", "al grupo  del-sol hoy", "acc1"), ("t4", "al grupo del mar", "acc1"), ("t5", "compra nu skin", "acc2"), ("t6", "spei a nu", "acc2"),
        ("t7", "banco", "acc3"), ("t8", None, "acc1"), ("t9", "", "acc1"), ("t10", "xmarca1", "acc1"), ("t1", "Pago MARCA1, gracias", "acc1"),
    ], "id string, text string, account_id string")
    found = transfers.token_mentions(texts, tokens)
    assert sorted(tuple(r) for r in found.collect()) == [("t1", "acc1"), ("t3", "acc1"), ("t6", "acc2")]
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


VERSION = "transaction_id string, statement_id string, account_id string, date_op date, description_norm string, fingerprint string, bank_ref string, period_start date, period_end date"


def random_versions(seed, n, side):
    rng = random.Random(seed)
    periods = {f"{s}{k}": (day(10 * (k % 4)), day(10 * (k % 4) + rng.randrange(5, 25))) for s in "on" for k in range(6)}
    periods["n5"] = (None, None)
    out = []
    for k in range(n):
        st = f"{rng.choice('on' if side == 'n' else 'oon')}{rng.randrange(6)}"
        out.append((f"{side}{k:03d}", st, rng.choice(["A", "B", None]), rng.choice([day(1), day(2), None]), rng.choice(["fee", "tax", ""]), f"f{rng.randrange(12)}", rng.choice([None, " ", "r1", "r1 ", "r2", "r3"]), *periods[st]))
    return out


def plain_versions(new, old):
    ref = lambda r: (r[6] or "").strip()
    out = set()
    for t in new:
        fits = [
            c for c in old
            if None not in (t[2], t[3], t[7], c[7]) and t[4] and t[2:5] == c[2:5] and t[1] != c[1] and t[5] != c[5] and c[7] <= t[8] and c[8] >= t[7] and (not ref(t) or not ref(c) or ref(t) == ref(c))
        ]
        siblings = [u for u in new if u[1:5] == t[1:5]]
        if fits:
            single = len(fits) == 1 and len(siblings) == 1
            out.add((t[0], fits[0][0] if single else None, not single))
    return out


@pytest.mark.parametrize(("seed", "n", "m", "few"), [(1, 40, 120, 0), (1, 40, 120, 4), (2, 25, 25, 0), (3, 60, 6, 16), (4, 12, 12, 0)])
def test_prior_versions_against_all_pairs(spark, monkeypatch, seed, n, m, few):
    monkeypatch.setattr(duplicates, "FEW", few)  # whichever way a key's classes are compared
    new, old = random_versions(seed, n, "n"), random_versions(seed + 50, m, "o")
    got = {tuple(r) for r in duplicates.prior_versions(spark.createDataFrame(new, VERSION), spark.createDataFrame(old, VERSION)).collect()}
    assert got == plain_versions(new, old)


def test_a_hundred_thousand_equal_fees_of_a_day(spark):
    n = 100_000
    k = F.col("id")
    many = lambda side, st: spark.range(n).select(
        F.concat(F.lit(side), k).alias("transaction_id"), F.concat(F.lit(st), k % 50).alias("statement_id"), F.lit("A").alias("account_id"), F.lit(DAY0).alias("date_op"), F.lit("fee").alias("description_norm"),
        F.concat(F.lit(side), k % 7).alias("fingerprint"), F.lit(None).cast("string").alias("bank_ref"), F.date_add(F.lit(DAY0), (-(k % 3)).cast("int")).alias("period_start"), F.date_add(F.lit(DAY0), (k % 5).cast("int")).alias("period_end"),
    )
    one = spark.createDataFrame([("m", "s", "B", DAY0, "fee", "x", None, DAY0, DAY0)], VERSION)
    fixed = one.withColumn("transaction_id", F.lit("p")).withColumn("statement_id", F.lit("q")).withColumn("fingerprint", F.lit("y"))
    found = duplicates.prior_versions(many("n", "v").union(fixed), many("o", "w").union(one))
    assert found.where("ambiguous").count() == n
    assert [tuple(r) for r in found.where("NOT ambiguous").collect()] == [("p", "m", False)]


def test_every_movement_has_its_class_and_partners(spark):
    day = lambda k: dt.date(2026, 1, k)
    rows = [(1, "A", day(1), -100), (2, "A", day(1), -100), (3, "B", day(2), 100), (4, "C", day(4), 100), (5, "A", day(3), 100), (6, "B", day(20), 100), (7, "B", None, 100), (8, "B", day(2), 0), (9, None, day(2), -100)]
    found = transfers.partner_counts(spark.createDataFrame(rows, "transaction_id long, account_id string, date_op date, amount_minor long"))
    assert {tuple(r) for r in found.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 4, 2), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0)}
