import datetime as dt

import pytest

from tallyspark.operators.consolidated import Mismatch, check_statements, export_consolidated

S = "statement_id string, account_id string, period_start date, period_end date, opening_minor long, closing_minor long, declared_count long, declared_credits long, declared_debits long"
R = "statement_id string, locator string, date_op date, description string, amount_minor long, doubtful boolean"
JAN, FEB = (dt.date(2026, 1, 1), dt.date(2026, 1, 31)), (dt.date(2026, 2, 1), dt.date(2026, 2, 28))


def tables(spark, extra=()):
    rows = [(s, f"line:{k}", dt.date(2026, 1, 5), f"r{k}", 100 if k % 2 else -50, False) for s in ("a", "b", "c") for k in (9999, 10000, 7)]
    rows += [("d", "line:1", None, "x", None, True), ("c", "line:8", dt.date(2026, 1, 6), "more", 5, False)]
    s = [("a", "A", *JAN, 0, 150, 3, 200, -50), ("b", "A", *JAN, 0, 150, 3, 200, 50), ("c", "A", *JAN, 0, 155, None, None, None), ("d", "A", *FEB, None, 5, 2, 0, 1), ("e", "B", None, None, 7, 7, 0, None, None)]
    return spark.createDataFrame([*s, *extra], S), spark.createDataFrame(rows, R)


def test_states_and_problems(spark):
    got = {r["statement_id"]: (r["state"], r["problems"], r["n"]) for r in check_statements(*tables(spark)).collect()}
    assert got["a"] == ("OK", [], 3) and got["b"] == ("DUPLICADO", [], 3) and got["e"] == ("OK", [], 0)
    assert got["c"] == ("NO_CUADRA", ["another content than a for the same period"], 4)
    assert got["d"] == ("NO_CUADRA", ["1 rows without amount", "1 doubtful rows", "opening or closing balance missing", "declares 2 rows, has 1", "declares debits 1, has 0"], 1)


def test_files_and_refusal(spark, tmp_path):
    with pytest.raises(Mismatch, match="c: another content"):
        export_consolidated(*tables(spark), f"{tmp_path}/x")
    assert not (tmp_path / "x" / "all").exists()
    read = lambda folder: [line for part in sorted((tmp_path / "x" / folder).rglob("part-*.csv")) for line in part.read_text().splitlines()[1:]]
    assert [line.split(",")[5] for line in read("by_statement/statement=a")] == ["line:7", "line:9999", "line:10000"]
    assert not (tmp_path / "x" / "by_statement" / "statement=b").exists()
    export_consolidated(*tables(spark), f"{tmp_path}/x", strict=False)
    every = [line.split(",") for line in read("all")]
    assert [x[5] for x in every if x[6] == "c"] == ["line:7", "line:8", "line:9999", "line:10000"] and len(every) == 8 and every[0][4] == "1.00"
