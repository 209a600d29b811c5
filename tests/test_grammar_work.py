import datetime as dt

from pyspark.sql import functions as F

from tallyspark.grammars import issuers

D = dt.date


def tables(spark, lines, periods):
    lines = spark.createDataFrame(lines, "doc_id string, line_no int, line string")
    docs = spark.createDataFrame(periods, "doc_id string, period_start date, period_end date").selectExpr("*", "'hsbc' AS bank", "'' AS text", "0L AS opening_minor", "0L AS closing_minor")
    return lines, docs


def searched(df, what):
    """How often an expression stands in the optimised plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_a_line_with_a_lone_day_is_searched_once(spark):
    lines, docs = tables(spark, [("d", 1, "05 SPEI $ 1 200.00 $ 1 200.00")], [("d", D(2026, 1, 1), D(2026, 1, 31))])
    found = issuers.day_column(lines, docs)
    assert searched(found, "aggregate(") == 1 and searched(found, "regexp_extract_all(") <= 3
    assert [(r["date_op"], r["amount_minor"]) for r in found.collect()] == [(D(2026, 1, 5), 120000)]


def test_days_of_periods_over_months(spark):
    said = lambda day: f"{day} SPEI $ 1.00 $ 1.00"
    periods = [("month", D(2026, 2, 1), D(2026, 2, 28)), ("two", D(2025, 12, 19), D(2026, 1, 18)), ("long", D(2026, 1, 30), D(2026, 3, 31)), ("odd", D(2026, 3, 1), D(2026, 2, 1)), ("none", None, D(2026, 2, 1))]
    days = (0, 1, 18, 19, 29, 30, 31, 32)
    lines, docs = tables(spark, [(p[0], k, said(k)) for p in periods for k in days], periods)
    got = {(r["doc_id"], r["line_no"]): r["date_op"] for r in issuers.day_column(lines, docs).collect()}

    def want(start, end, day):
        inside = [d for n in range((end - start).days + 1) if (d := start + dt.timedelta(n)).day == day]
        return inside[0] if len(inside) == 1 else None

    assert got == {(n, k): want(a, b, k) for n, a, b in periods[:3] for k in days}


def test_lines_are_dealt_to_the_grammars_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(line):
        seen.add(1)
        return line

    said = {"nu": "10 ENE 2026 Tienda +$1.00", "gbm": "01/01/2026 Deposito 5.00 15.00", "vexi": "05/01/2026 Cafe $50.00", "bbva": "19/DIC 19/DIC SPEI 1.00", None: "2026-01-06 Otra 1.50", "other": "x"}
    docs = spark.createDataFrame([(str(b), b) for b in said], "doc_id string, bank string").selectExpr("*", "'' AS text", "DATE'2025-12-19' AS period_start", "DATE'2026-01-18' AS period_end", "1000L AS opening_minor", "900L AS closing_minor")
    lines = spark.createDataFrame([(str(b), 1, x) for b, x in said.items()], "doc_id string, line_no int, line string").repartition(2).withColumn("line", counted("line"))
    got = {r["doc_id"]: r["amount_minor"] for r in issuers.parse_lines(lines, docs).collect()}
    assert got == {"nu": 100, "gbm": 500, "vexi": 5000, "bbva": -100, "None": 150}
    assert seen.value == len(said)
