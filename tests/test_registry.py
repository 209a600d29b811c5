import datetime as dt

import pytest

from tallyspark.grammars import issuers
from tallyspark.grammars.registry import COLUMNS, LineGrammar, Movement, parse_registered, register_grammar


def grammar():
    class Pipes(LineGrammar):  # local, so that workers get it by value
        def line(self, row):
            parts = row["line"].split("|")
            self.state["n"] = self.state.get("n", 0) + 1
            if len(parts) == 3:
                yield Movement(row["line_no"], parts[0], dt.date.fromisoformat(parts[0]), description=parts[1], detail=row["hint"], amount_minor=int(parts[2]))
            elif parts[0]:
                yield Movement(row["line_no"], warning="not three parts")

        def end(self):
            yield Movement(0, warning=f"{self.state['n']} lines")

    return Pipes


def tables(spark):
    lines = spark.createDataFrame([("d", 2, "2026-01-03|b|-7", "h2"), ("d", 1, "2026-01-02|a|5", "h1"), ("d", 3, "odd", None), ("e", 1, "", None), ("f", 1, "2026-01-04|c|9", None), ("n", 1, "02 ENE 2026 x +$1.00", None)], "doc_id string, line_no int, line string, hint string")
    docs = spark.createDataFrame([("d", "pipes"), ("e", "pipes"), ("f", "other"), ("n", "nu")], "doc_id string, bank string")
    docs = docs.selectExpr("*", "'' AS text", "cast(null AS date) AS period_start", "cast(null AS date) AS period_end", "0L AS opening_minor", "0L AS closing_minor")
    return lines, docs


def test_documents_of_a_registered_issuer_go_to_its_grammar(spark):
    lines, docs = tables(spark)
    grammars = {"pipes": register_grammar(spark, "pipes", grammar())}
    got = issuers.parse_lines(lines, docs, grammars)
    assert tuple(got.columns) == COLUMNS
    rows = {(r["doc_id"], r["line_no"], r["date_op"], r["description"], r["detail"], r["amount_minor"]) for r in got.collect()}
    assert rows == {("d", 1, dt.date(2026, 1, 2), "a", "h1", 5), ("d", 2, dt.date(2026, 1, 3), "b", "h2", -7), ("n", 1, dt.date(2026, 1, 2), "x", None, 100)} | {r for r in rows if r[0] == "n"}
    assert {tuple(r) for r in issuers.warnings(lines, docs, grammars).collect()} >= {("d", 3, "not three parts"), ("d", 0, "3 lines"), ("e", 0, "1 lines")}
    assert issuers.parse_lines(lines, docs).where("doc_id IN ('d', 'e', 'f')").count() == 0


def test_sql_calls_a_registered_grammar(spark):
    lines, _ = tables(spark)
    name = register_grammar(spark, "pipes", grammar())
    lines.createOrReplaceTempView("printed_lines")
    got = spark.sql(f"SELECT doc_id, sum(amount_minor) AS s, count(warning) AS w FROM {name}(TABLE(printed_lines) PARTITION BY doc_id ORDER BY line_no) GROUP BY doc_id").collect()
    assert {tuple(r) for r in got} == {("d", -2, 2), ("e", None, 1), ("f", 9, 1), ("n", None, 2)}


def test_wrong_tables_and_names_are_refused(spark):
    name = register_grammar(spark, "pipes", grammar())
    with pytest.raises(Exception, match="the lines lack line"):
        spark.sql(f"SELECT * FROM {name}(TABLE(SELECT 1 AS doc_id, 1 AS line_no) PARTITION BY doc_id)").collect()
    with pytest.raises(ValueError, match="no name of an issuer"):
        register_grammar(spark, "x; DROP", grammar())
    assert parse_registered(*tables(spark), {}) is None
