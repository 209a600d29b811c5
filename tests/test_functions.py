from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, ids, money, text

AMOUNTS = {
    "$1,234.56": 123456, "1.234,56": 123456, "-123.45": -12345, "(123.45)": -12345, "1 234,56": 123456, "MXN 1,000.00": 100000, "": None, "-": None, "—": None, "N/A": None, "n/a": None,
    "1e5": 1500, "(-5)": 500, "5-": None, "--5": None, "1,23,45": None, "1.2.3": 12300, "5.000": None, "0.125": None, "1234.567": 123457, "1,234": 123400, "12,5": 1250, ".5": 50, "5.": 500,
    "abc": None, "+7.10": 710, "1.005": None, "10.005": None, "99999.995": 10000000, "-0.005": None, "9999999999999.99": 999999999999999, "99999999999999.99": None, None: None, "1,234.5.6": None,
}


def test_amount_truth_table(spark):
    df = spark.createDataFrame([(k,) for k in AMOUNTS], "t string")
    got = {r["t"]: r["m"] for r in money.with_parsed_amount(df, "t", F.lit("MXN"), "m").collect()}
    assert got == AMOUNTS


def test_currencies(spark):
    df = spark.createDataFrame([(Decimal("10.50"), "CLP"), (Decimal("-10.50"), "jpy"), (Decimal("10.005"), "MXN"), (Decimal("1"), None)], "a decimal(20,6), c string")
    got = df.select(money.to_minor(F.col("a"), F.col("c")).alias("m"), F.col("c")).select("m", money.from_minor(F.col("m"), F.col("c")).alias("d"), money.format_minor(F.col("m"), F.col("c")).alias("s")).collect()
    assert [r["m"] for r in got] == [11, -11, 1001, 100]
    assert got[2]["d"] == Decimal("10.01") and got[2]["s"] == "10.01 MXN" and got[0]["s"] == "11 CLP"


DATES = {
    "2026-02-03": "2026-02-03", "2026-2-3": None, "2026-02-30": None, "3/2/26": "2026-02-03", "13-02.2026": "2026-02-13", "02/13/2026": "2026-02-13", "13/13/2026": None, "15 jun 2026": "2026-06-15",
    "15 JUNIO 26": "2026-06-15", "15 junk 2026": "2026-06-15", "15 jun. 2026": None, "15 jun": "2025-06-15", "15 xyz 2026": None, " 1-ene-2026 ": "2026-01-01", "31 feb 2026": None, "": None, None: None, "0000-01-01": None,
}


def test_date_table(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", dates.normalize_date(F.col("t"), F.lit(2025)).cast("string").alias("d")).collect()}
    assert got == DATES


@pytest.mark.parametrize(("day", "raw", "want"), [("2026-12-28", "28/DIC", "2025-12-28"), ("2026-01-05", "05/ENE", "2026-01-05"), ("2026-12-28", "28/12/2026", "2026-12-28"), ("2025-01-19", "19 ENE", "2026-01-19"), ("2026-08-01", "01 AGO", "2026-08-01")])
def test_year_by_period(spark, day, raw, want):
    df = spark.createDataFrame([(day, raw, "2025-12-19", "2026-01-18")], "d string, r string, s string, e string")
    c = lambda n: F.col(n).cast("date")
    assert str(df.select(dates.resolve_year(c("d"), F.col("r"), c("s"), c("e")).alias("x")).first()["x"]) == want


def test_merchants_and_descriptions(spark):
    rows = [("  COMPRA  CаSINO  REF: AB-12 *123456 mx ", "casino"), ("ＯＸＸＯ #77", "oxxo 77"), (None, ""), ("Folio 99 Tienda folio", "tienda folio")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    got = [r["m"] for r in df.select(text.normalize_merchant(F.col("t"), compose=True).alias("m")).collect()]
    assert got == [b for _, b in rows]
    assert df.select(text.normalize_description(F.col("t")).alias("d")).first()["d"] == "COMPRA CаSINO REF: AB-12 *123456 mx"


def test_harmless_text(spark):
    df = spark.createDataFrame([("=1+1", "a`b\x07c\n d" + "x" * 200)], "a string, b string")
    r = df.select(text.csv_safe(F.col("a")).alias("a"), text.untrusted(F.col("b"), 10).alias("b"), text.mask_long_digits(F.lit("no 1234567890 yes 123456789")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("'=1+1", "a'bc dxxxx…", "no …7890 yes 123456789")


def test_holder_and_tokens(spark):
    df = spark.createDataFrame([("SPEI de JUAN  PÉREZ, López",), ("XJUAN PEREZ LOPEZ",), ("compra NU SKIN",), ("traspaso a NU",)], "t string")
    r = df.select(text.mentions_holder(F.col("t"), "Juan Pérez López").alias("h"), text.mentions_token(F.col("t"), F.lit("nu"), (), 3, "traspaso|spei").alias("k")).collect()
    assert [(x["h"], x["k"]) for x in r] == [(True, False), (False, False), (False, False), (False, True)]
    assert not df.select(text.mentions_holder(F.col("t"), "Juan").alias("h")).first()["h"]


def test_ids_keep_places_of_missing_parts(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    got = [r["i"] for r in df.select(ids.digest(F.col("x"), F.col("y"), F.col("z")).alias("i")).collect()]
    assert len(set(got)) == 2 and all(len(g) == 16 for g in got)
