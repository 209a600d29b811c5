import datetime as dt

from tallyspark.grammars import issuers
from tallyspark.grammars.registry import LineGrammar, Movement, read_registered, register_grammar
from tallyspark.session import bounded


def tables(spark):
    lines = [("d", 3, "2026-01-03|b|-7"), ("d", 1, "2026-01-02|a|5"), ("d", 2, "odd"), ("e", 1, "odd"), ("f", 1, "2026-01-04|c|9"), ("n", 1, "02 ENE 2026 x +$1.00")]
    docs = spark.createDataFrame([("d", "pipes"), ("e", "pipes"), ("f", "other"), ("n", "nu")], "doc_id string, bank string")
    docs = docs.selectExpr("*", "'' AS text", "cast(null AS date) AS period_start", "cast(null AS date) AS period_end", "0L AS opening_minor", "0L AS closing_minor")
    return spark.createDataFrame(lines, "doc_id string, line_no int, line string"), docs


def grammar(seen):
    class Pipes(LineGrammar):
        def line(self, row):
            seen.add(1)
            parts = row["line"].split("|")
            self.state["n"] = self.state.get("n", 0) + 1
            if len(parts) == 3:
                yield Movement(row["line_no"], parts[0], dt.date.fromisoformat(parts[0]), description=parts[1], amount_minor=int(parts[2]), warning="low" if int(parts[2]) < 0 else None)
            else:
                yield Movement(row["line_no"], warning=f"line {self.state['n']} is not three parts")

        def end(self):
            yield Movement(0, warning=f"{self.state['n']} lines")

    return Pipes


def test_movements_and_warnings_come_from_one_reading(spark):
    seen = spark.sparkContext.accumulator(0)
    lines, docs = tables(spark)
    grammars = {"pipes": register_grammar(spark, "pipes", grammar(seen))}
    got = [(r["doc_id"], r["line_no"], r["amount_minor"], r["warning"] or "") for r in issuers.read_lines(lines, docs, grammars).collect()]
    assert seen.value == 4
    assert sorted(got, key=str) == [("d", 0, None, "3 lines"), ("d", 1, 5, ""), ("d", 2, None, "line 2 is not three parts"), ("d", 3, -7, ""), ("d", 3, None, "low"), ("e", 0, None, "1 lines"), ("e", 1, None, "line 1 is not three parts"), ("n", 1, 100, "")]
    apart = [(r["doc_id"], r["line_no"], r["amount_minor"], "") for r in issuers.parse_lines(lines, docs, grammars).collect()] + [(r["doc_id"], r["line_no"], None, r["warning"]) for r in issuers.warnings(lines, docs, grammars).collect()]
    assert sorted(apart, key=str) == sorted(got, key=str)


def test_classes_give_what_their_table_functions_give(spark):
    lines, docs = tables(spark)
    name = register_grammar(spark, "pipes", grammar(spark.sparkContext.accumulator(0)))
    own = lines.where("doc_id IN ('d', 'e')").repartition(3)
    by_sql = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{own}}) PARTITION BY doc_id ORDER BY line_no)", own=own)
    by_class = read_registered(lines, docs, {"pipes": name})
    assert by_sql.schema == by_class.schema and sorted(map(str, by_sql.collect())) == sorted(map(str, by_class.collect()))


def test_partitions_follow_rows(spark):
    rows = spark.range(1000).selectExpr("id", "id % 50 AS k")
    assert bounded(rows, "k", most=20).rdd.getNumPartitions() == 50
    assert bounded(rows, "k").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
