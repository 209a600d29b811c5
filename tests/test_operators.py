import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import balances, categorize, duplicates, identify, reconcile, transfers, validate

D = dt.date


def test_reconcile_verdicts(spark):
    s = spark.createDataFrame(
        [("ok", 100, 150, 2, None, None, 0), ("count", 100, 150, 3, None, None, 0), ("totals", 100, 150, 2, 70, -20, 0), ("off", 100, 151, 2, None, None, 0), ("near", 100, 151, 2, None, None, 1), ("open", None, 150, 2, None, None, 0), ("none", 5, 5, None, None, None, 0)],
        "statement_id string, opening_minor long, closing_minor long, declared_count long, declared_credits long, declared_debits long, tolerance_minor long")
    r = spark.createDataFrame([(k, m) for k in ("ok", "count", "totals", "off", "near", "open") for m in (80, -30)], "statement_id string, amount_minor long")
    got = {x["statement_id"]: (x["result"], x["diff_minor"], x["coverage_ok"]) for x in reconcile.reconcile(s, r).collect()}
    assert got == {"ok": ("OK", 0, True), "count": ("WARNING", 0, False), "totals": ("WARNING", 0, True), "off": ("BLOCKED", -1, True), "near": ("OK", -1, True), "open": ("REVIEW_REQUIRED", None, True), "none": ("OK", 0, None)}


def movements(spark, rows):
    full = [(i, a, d, m, ref, text, kind, new) for i, a, d, m, ref, text, kind, new in rows]
    return spark.createDataFrame(full, "transaction_id string, account_id string, date_op date, amount_minor long, bank_ref string, description_norm string, account_type string, is_new boolean").withColumn("currency", F.lit("MXN"))


def test_transfer_signals(spark):
    rows = [
        ("d1", "A", D(2026, 1, 1), -100, "700123", "envio", "debito", True), ("c1", "B", D(2026, 1, 2), 100, "7001239", "abono", "debito", True),
        ("d2", "A", D(2026, 1, 1), -200, None, "Transferencia a Bancolor", "debito", True), ("c2", "B", D(2026, 1, 3), 200, None, "x", "debito", True),
        ("d3", "A", D(2026, 1, 1), -300, None, "spei", "debito", True), ("c3", "B", D(2026, 1, 1), 300, None, "de ANA LUZ Sol", "debito", True),
        ("d4", "A", D(2026, 1, 1), -400, None, "Pago a tu tarjeta", "debito", True), ("c4", "C", D(2026, 1, 1), 400, None, "gracias por su PAGO", "credito_tdc", True),
        ("d5", "A", D(2026, 1, 1), -500, None, "nada", "debito", True), ("c5", "B", D(2026, 1, 1), 500, None, "nada", "debito", True),
        ("d6", "A", D(2026, 1, 1), -600, "ABCDEF1", "x", "debito", True), ("c6", "B", D(2026, 1, 1), 600, "ABCDEF1", "x", "debito", True), ("e6", "C", D(2026, 1, 1), 600, "ABCDEF1", "x", "debito", False),
        ("d7", "A", D(2026, 1, 1), -700, "R", "x", "debito", True), ("c7", "B", D(2026, 1, 9), 700, "R", "x", "debito", True), ("d8", "A", D(2026, 1, 1), -800, "R", "x", "debito", False), ("c8", "B", D(2026, 1, 1), 800, "R", "x", "debito", False),
    ]
    df = movements(spark, rows)
    accounts = spark.createDataFrame([("A", "Uno", "Alfa"), ("B", "Dos", "Bancolor"), ("C", "Tres", "Gama")], "account_id string, name string, institution string")
    tokens = transfers.account_tokens(accounts)
    got = {(r["from_id"], r["to_id"]): (r["signal"], r["confidence"], r["kind"]) for r in transfers.transfer_links(df, tokens, "Ana Luz Sol").collect()}
    assert got == {("d1", "c1"): ("bank_ref", 0.95, "transfer"), ("d2", "c2"): ("counterparty_token", 0.8, "transfer"), ("d3", "c3"): ("titular", 0.85, "transfer"), ("d4", "c4"): ("pago_tarjeta", 0.85, "card_payment")}
    assert {r[0] for r in transfers.transfer_reviews(df, tokens, "Ana Luz Sol").collect()} == {"d5", "c5", "d6", "c6"}
    assert {r[0] for r in transfers.transfer_reviews(df, tokens, "Ana Luz Sol", bucket_cap=2).collect()} == {"d5", "c5", "d6", "c6"}
    plan = transfers.transfer_pairs(df)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_links_do_not_depend_on_order_or_runs(spark):
    rows = [(f"{s}{k}", "AB"[s == "c"], D(2026, 1, 1 + k % 5), (-1 if s == "d" else 1) * 100 * (1 + k % 7), f"REF{k % 11:04d}", "x", "debito", True) for k in range(60) for s in "dc"]
    one = {tuple(r) for r in transfers.transfer_links(movements(spark, rows)).select("from_id", "to_id").collect()}
    two = {tuple(r) for r in transfers.transfer_links(movements(spark, rows[::-1])).select("from_id", "to_id").collect()}
    assert one == two and one


def test_reviews_follow_their_sql_beyond_the_cap(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    con.sql("""CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (k) MINUTE AS ts, k % 7 AS user_id, CASE WHEN k % 2 = 0 THEN 'purchase' ELSE 'view' END AS event_type,
      CASE WHEN k < 301 THEN 9.5 ELSE (k // 3)::DOUBLE END AS value, '{"k": ' || k || '}' AS props FROM (SELECT unnest(range(400)) AS k)""")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("transfer_reviews", "transfer_pairs", "transfer_degree_guard"):
        got = queries()[name](spark, str(tmp_path))
        want = con.sql(oracle_sql()[name]).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
        if name == "transfer_reviews":
            assert {r[0] for r in want} > set(range(301))


def test_duplicates_pair_the_kth_with_the_kth(spark):
    schema = "transaction_id string, statement_id string, fingerprint string, bank_ref string, period_start date, period_end date"
    p, q = (D(2026, 1, 1), D(2026, 1, 31)), (D(2026, 3, 1), D(2026, 3, 31))
    old = spark.createDataFrame([("o1", "s0", "f", None, *p), ("o2", "s0", "g", "r", *p), ("o3", "s0", "h", None, *p)], schema)
    new = spark.createDataFrame([("n1", "s1", "f", None, *p), ("n2", "s1", "f", None, *p), ("n3", "s1", "g", "r", *q), ("n4", "s1", "h", None, *q), ("n5", "s0", "h", None, *p)], schema)
    got = {r["transaction_id"]: (r["dup_of"], r["reason"], r["suspicious"]) for r in duplicates.find_duplicates(new, old).collect()}
    assert got == {"n1": ("o1", "misma huella en periodos solapados", False), "n3": ("o2", "mismo bank_ref", False), "n4": (None, None, True)}


def test_contents_and_versions(spark):
    s = spark.createDataFrame([("a", D(2026, 1, 1), D(2026, 1, 31)), ("b", D(2026, 1, 1), D(2026, 1, 31)), ("c", D(2026, 2, 1), D(2026, 2, 28))], "statement_id string, period_start date, period_end date")
    r = spark.createDataFrame([(k, D(2026, 1, 2), m, "x") for k in "abc" for m in (5, 7)], "statement_id string, date_op date, amount_minor long, description_norm string")
    assert {x["statement_id"] for x in duplicates.distinct_contents(s, r).collect()} == {"a", "c"}


def test_segments(spark):
    rows = [(1, 100, None), (2, 50, 1150), (3, 70, None), (4, 30, 1110), (5, 10, None), (6, 10, 1110), (7, 25, None)]
    df = spark.createDataFrame([("s", k, m, b, 1000, 1135) for k, m, b in rows], "doc string, k int, magnitude_minor long, balance_minor long, opening_minor long, closing long")
    seg = balances.with_segments(df, "doc", ["k"], closing="closing")
    got = {r["k"]: r["sign"] for r in balances.solve_segments(seg, "doc", "k").collect()}
    assert got == {1: 1, 2: 1, 3: -1, 4: 1, 5: 0, 6: 0, 7: 1}


def test_balance_signs(spark):
    rows = [(1, 50, 950), (2, 20, None), (3, 30, 980), (4, 7, 990)]
    df = spark.createDataFrame([("s", k, m, b, 1000) for k, m, b in rows], "doc string, k int, magnitude_minor long, balance_minor long, opening_minor long")
    got = {r["k"]: (r["amount_minor"], r["doubtful"]) for r in balances.signs_from_balance(df, "doc", ["k"]).collect()}
    assert got == {1: (-50, False), 2: (20, True), 3: (30, False), 4: (7, True)}


def test_categories_history_and_corrections(spark):
    rows = spark.createDataFrame([("t1", "oxxo centro", None), ("t2", "cine", None), ("t3", "algo", None)], "transaction_id string, merchant_norm string, type string")
    rules = [{"priority": 50, "op": "contains", "value": "OXXO", "category": "tienda"}, {"priority": 10, "op": "regex", "value": r"^\S+ centro", "category": "centro"}, {"op": "regex", "value": "(", "category": "x"}, {"op": "regex", "value": "(?P<x>a)", "category": "y"}]
    past = spark.createDataFrame([("cine", "ocio")], "merchant_norm string, category string")
    done = categorize.categorize(rows, rules, past)
    assert {r["transaction_id"]: (r["category"], r["category_source"], r["review_status"]) for r in done.collect()} == {"t1": ("centro", "rule", "ok"), "t2": ("ocio", "history", "ok"), "t3": ("Por revisar", "none", "por_revisar")}
    fixes = spark.createDataFrame([("t3", "category", "casa"), ("t9", "category", "x"), ("t1", "tag", "y")], "transaction_id string, field string, new_value string")
    out, bad = categorize.apply_corrections(done, fixes)
    assert out.where("transaction_id = 't3'").select("category", "category_source").first() == ("casa", "manual")
    assert {(r["transaction_id"], r["reason"]) for r in bad.collect()} == {("t9", "unknown transaction"), ("t1", "field not allowed")}


def test_identification_abstains_on_ties(spark):
    docs = spark.createDataFrame([("1", "Cuenta Dorada del Banco Mar, cuenta dorada"), ("2", "banco"), ("3", "")], "doc_id string, text string")
    hints = spark.createDataFrame([("a", "cuenta dorada"), ("a", "Cuenta  Dorada"), ("a", "x"), ("b", "banco mar"), ("b", "banco"), ("c", "báncó")], "account_id string, hint string")
    got = {r["doc_id"]: (r["account_id"], r["margin"]) for r in identify.identify_accounts(identify.account_scores(docs, hints)).collect()}
    assert got == {"1": ("a", 1), "2": (None, 0)}
    banks = docs.select(identify.detect_bank(F.lit("BBVA nu mexico Nubank hsbc")).alias("b"), identify.detect_bank(F.lit("zzz"), hint=F.lit("vexi_tdc")).alias("h")).first()
    assert banks == ("nu", "vexi")


def test_states_and_blocks(spark):
    df = spark.createDataFrame([("VALIDATED", "READY_TO_COMMIT"), ("COMMITTED", "HASHED"), ("FAILED", "HASHED")], "src string, dst string")
    assert {tuple(r) for r in validate.illegal_transitions(df).collect()} == {("COMMITTED", "HASHED"), ("FAILED", "HASHED")}
    s = spark.createDataFrame([(["x"], "OK"), (["inactive_account"], "OK"), ([], "WARNING"), ([], None)], "b array<string>, r string")
    got = [r[0] for r in s.select(validate.decide_state(F.col("b"), F.col("r"))).collect()]
    assert got == ["READY_TO_COMMIT", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "REVIEW_REQUIRED"]


def test_hints_that_repeat_themselves_and_headers(spark):
    docs = spark.createDataFrame([("1", "la la la la la", "x"), ("2", "", "banco sol y banco luz banco luz"), ("3", "banco sol", "banco luz banco luz"), ("4", "nada", "nada")], "doc_id string, header string, text string")
    hints = spark.createDataFrame([("a", "la la"), ("s", "banco sol"), ("l", "banco luz")], "account_id string, hint string")
    assert {(r["doc_id"], r["account_id"], r["score"]) for r in identify.account_scores(docs, hints, "header").collect()} == {("1", "a", 4), ("3", "s", 2)}
    got = {r["doc_id"]: (r["account_id"], r["method"]) for r in identify.identified(docs, hints).collect()}
    assert got == {"1": ("a", "match_hints:header"), "2": ("l", "match_hints:full"), "3": ("s", "match_hints:header"), "4": (None, "ambiguous_or_none")}
    plan = identify.account_scores(docs, hints)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
