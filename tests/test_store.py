import json

import pytest
from pyspark.sql import functions as F

from tallyspark.grammars import issuers, parse_lines
from tallyspark.operators import ledger, transfers
from tallyspark.operators.lines import text_lines, with_period
from tallyspark.plans import ingest
from tallyspark.sources import statements
from tallyspark.store import Busy, Store, approve, content_digest, export

MAR = """# account_id: mar_debito
# currency: MXN
# period_start: 2026-06-01
# period_end: 2026-06-30
# opening_balance: 1,000.00
# closing_balance: 15,800.00
# declared_count: 4
fecha,concepto,importe,saldo,folio
2026-06-01,Nomina Empresa,"20,000.00","21,000.00",N1
05/06/2026,"TRASPASO A Sol, ahorro",-5000.00,,TRX900100

12 jun 2026,Oxxo Centro REF 123,(150.00),,
30/06/2026,COMISION anual,-50,,
"""
SOL = """fecha_op,descripción,monto,ref
2026-06-06,Abono SPEI,5000.00,TRX900100
# account_id: sol_ahorro
# period_start: 2026-06-01
# period_end: 2026-06-30
# opening_balance: 0
# closing_balance: 5000.00
"""
BAD = MAR.replace("15,800.00", "15,800.01").replace("mar_debito", "rio_debito")


@pytest.fixture
def inbox(tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    (box / "mar.csv").write_text("﻿" + MAR, encoding="utf-8")
    (box / "sol.csv").write_text(SOL, encoding="utf-8")
    (box / "note.md").write_text("x")
    return box


@pytest.fixture
def config(spark):
    rows = [("mar_debito", "Mar", "Banco Mar", "MXN", "debito", True, False), ("sol_ahorro", "Sol", "Banco Sol", "MXN", "ahorro", True, False), ("rio_debito", "Rio", "Banco Rio", "MXN", "debito", True, False)]
    accounts = spark.createDataFrame(rows, "account_id string, name string, institution string, currency string, type string, active boolean, inverted boolean")
    return ingest.Config(accounts, [{"priority": 40, "op": "contains", "value": "oxxo", "category": "tienda"}])


def stage(spark, box, config, committed=None):
    return ingest.build(statements.read_statements(statements.discover(spark, f"file://{box}")), config, committed)


def states(staged):
    return {r["account_id"]: (r["state"], r["result"], r["diff_minor"]) for r in staged.statements.collect()}


def test_preview(spark, inbox, config):
    staged = stage(spark, inbox, config)
    assert states(staged) == {"mar_debito": ("READY_TO_COMMIT", "OK", 0), "sol_ahorro": ("READY_TO_COMMIT", "OK", 0)}
    rows = {r["description_norm"]: r for r in staged.rows.collect()}
    assert len(rows) == 5 and rows["Oxxo Centro REF 123"]["category"] == "tienda" and rows["Oxxo Centro REF 123"]["amount_minor"] == -15000
    assert rows["COMISION anual"]["type"] == "comision" and rows["Nomina Empresa"]["review_status"] == "por_revisar"
    assert [(r["signal"], r["amount_minor"]) for r in staged.links.collect()] == [("bank_ref", 500000)]
    assert all(not r["errors"] and not r["flags"] for r in rows.values())


def test_unreadable_and_doubtful(spark, inbox, config):
    (inbox / "x.xlsx").write_bytes(b"no workbook")
    (inbox / "bad.csv").write_text(BAD.replace("12 jun 2026", "31/02/2026"), encoding="utf-8")
    raw = statements.read_statements(statements.discover(spark, f"file://{inbox}"))
    assert {r["method"] for r in raw.collect()} == {"csv", "unreadable:xlsx"}
    staged = ingest.build(raw, config)
    s = {r["account_id"]: r for r in staged.statements.collect()}
    assert s["rio_debito"]["state"] == "REVIEW_REQUIRED" and s["rio_debito"]["result"] == "BLOCKED" and "missing_critical_fields" in s["rio_debito"]["blocks"]
    assert s[None]["blocks"] == ["account_not_identified"]
    with pytest.raises(ValueError):
        approve(staged, s["rio_debito"]["statement_id"], "looks fine")


def snapshot(store):
    rows = store.transactions()
    return sorted(map(str, rows.select("transaction_id", "dup_of", "review_status", "amount_minor").collect())) if rows is not None else []


def test_commit_is_idempotent_and_reversible(spark, inbox, config, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    staged = stage(spark, inbox, config)
    assert store.seal(staged, b"k") == store.seal(stage(spark, inbox, config), b"k") != store.seal(staged, b"other")
    assert store.commit("r1", staged) == {"statements": 2, "transactions": 5, "links": 1}
    before = snapshot(store)
    again = stage(spark, inbox, config, store.transactions())
    assert store.commit("r2", again)["statements"] == 0
    assert snapshot(store) == before and store.doctor() == []
    assert store.commit("r1", staged) == {"statements": 2, "transactions": 5, "links": 1} and snapshot(store) == before
    # a corrected re-issue supersedes the row it corrects, and rolling it back restores that
    fixed = tmp_path / "fixed"
    fixed.mkdir()
    (fixed / "mar2.csv").write_text(MAR.replace("(150.00)", "(160.00)").replace("15,800.00", "15,790.00"), encoding="utf-8")
    rev = stage(spark, fixed, config, store.transactions())
    store.commit("r3", rev)
    live = store.transactions()
    old = live.where("description_norm LIKE 'Oxxo%' AND amount_minor = -15000").first()
    new = live.where("description_norm LIKE 'Oxxo%' AND amount_minor = -16000").first()
    assert old["dup_of"] == new["transaction_id"] and new["dup_of"] is None
    store.rollback("r3")
    assert snapshot(store) == before
    with pytest.raises(ValueError):
        store.rollback("r3")
    store.rollback("r1")
    store.rollback("r2")
    assert store.transactions() is None or store.transactions().count() == 0


def dimensions(config):
    accounts = config.accounts.withColumn("institution_id", F.col("institution"))
    return accounts, accounts.select("institution_id", F.col("institution").alias("name")).distinct()


def test_quarantine_approve_commit_export(spark, inbox, config, tmp_path):
    # three rows too few for the declared count: a warning, to be looked at
    (inbox / "odd.csv").write_text(MAR.replace("mar_debito", "rio_debito").replace("declared_count: 4", "declared_count: 7"), encoding="utf-8")
    store = Store(spark, f"file://{tmp_path}/ledger")
    staged = stage(spark, inbox, config)
    assert states(staged)["rio_debito"] == ("REVIEW_REQUIRED", "WARNING", 0)
    assert store.commit("r1", staged, config) == {"statements": 2, "transactions": 5, "links": 0}  # two accounts may have sent the 5,000
    held = store.quarantine().collect()
    assert [(r["account_id"], r["month"], r["n"], r["amount_minor"]) for r in held] == [("rio_debito", "2026-06", 4, 2_520_000)]
    accounts, banks = dimensions(config)
    out = f"file://{tmp_path}/out"
    contract = export(store, accounts, banks, out)
    assert (contract["n_rows"], contract["quarantine_statements"], contract["quarantine_txns"], contract["quarantine_amount_minor"], contract["review_txns"]) == (5, 1, 4, 2_520_000, 0)
    assert store.export_state() == "EXPORTED"
    assert store.close_month("c0", "2026-06") == (["mar_debito", "sol_ahorro"], ["rio_debito"])
    # the same staged run, approved: its statement enters, the others are skipped
    assert store.export_state() == "COMMITTED"
    ready = approve(staged, held[0]["statement_id"], "seven lines are four movements")
    assert store.commit("r2", ready, config) == {"statements": 1, "transactions": 4, "links": 0}
    assert store.quarantine().count() == 0 and store.transactions().count() == 9 and store.doctor() == []
    contract = export(store, accounts, banks, out)
    assert contract["n_rows"] == 9 and contract["quarantine_statements"] == 0 and contract["schema_version"] == "1.1.0"
    assert contract["columns"] == ["transaction_id", "fecha", "cuenta", "institucion", "descripcion", "categoria", "tipo", "importe", "moneda", "ingreso_gasto", "es_transferencia", "estado_revision", "bank_ref", "fingerprint"]
    assert json.loads(store.read_text(f"{out}/_contract.json"))["content_sha256"] == contract["content_sha256"]
    assert {r["account_id"]: r["result"] for r in store.months().collect()} == {"mar_debito": "OK", "sol_ahorro": "OK", "rio_debito": "WARNING"}
    assert {t: store.status()[t] for t in ("accounts", "institutions", "quarantine")} == {"accounts": 3, "institutions": 3, "quarantine": 1}


def test_closed_months_and_resolution(spark, inbox, config, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    staged = stage(spark, inbox, config)
    one = staged.rows.where("account_id = 'mar_debito'").orderBy("transaction_id").first()["transaction_id"]
    marked = staged.rows.withColumn("review_status", F.when(F.col("transaction_id") == one, "cuarentena").otherwise(F.col("review_status")))
    store.commit("r1", ingest.Staged(staged.statements, marked, staged.links))
    assert store.close_month("c1", "2026-06") == (["sol_ahorro"], ["mar_debito"])
    with pytest.raises(ValueError):
        store.rollback("r1")
    with pytest.raises(ValueError):
        store.resolve("q0", one, " ")
    store.resolve("q1", one, "checked by hand")
    store.resolve("q1", one, "checked by hand") if store.transactions().where(F.col("transaction_id") == one).first()["review_status"] == "cuarentena" else None
    assert store.transactions().where("review_status = 'cuarentena'").count() == 0
    assert store.close_month("c2", "2026-06")[0] == ["mar_debito", "sol_ahorro"]
    # a later statement with rows in a closed month is held back
    late = tmp_path / "late"
    late.mkdir()
    (late / "l.csv").write_text(SOL.replace("5000.00,TRX900100", "70.00,").replace("closing_balance: 5000.00", "closing_balance: 70.00"), encoding="utf-8")
    assert store.commit("r2", stage(spark, late, config, store.transactions()))["statements"] == 0
    assert [(r["reason"], r["n"]) for r in store.quarantine().collect()] == [("month_closed", 1)] and store.transactions().where("amount_minor = 7000").count() == 0


def test_retries_and_second_writers(spark, inbox, config, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    staged = stage(spark, inbox, config)
    staged.rows.limit(1).write.parquet(f"{store.root}/transactions/run_id=r1")  # what a crashed try left behind
    (tmp_path / "ledger" / "_draft-x").write_text("{")
    assert store.commit("r1", staged)["transactions"] == 5 and store.transactions().count() == 5
    other, seen = Store(spark, store.root), store.manifest()
    other._publish(seen | {"runs": [*seen["runs"], "r9"]})
    with pytest.raises(Busy):
        store._publish(seen | {"runs": [*seen["runs"], "r8"]})
    assert store.manifest()["runs"] == ["r1", "r9"] and not [n for n in store.names(store.root) if n.startswith("_draft-") and n != "_draft-x"]


def test_staged_runs_are_validated_again(spark, inbox, config, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    staged = stage(spark, inbox, config)
    forged = staged.rows.withColumn("amount_minor", F.when(F.col("amount_minor") == -5000, -6000).otherwise(F.col("amount_minor")))
    with pytest.raises(ValueError, match="does not follow from its fields"):
        store.commit("r1", ingest.Staged(staged.statements, forged, staged.links), config)
    idle = ingest.Config(config.accounts.withColumn("active", F.col("account_id") != "sol_ahorro"))
    with pytest.raises(ValueError, match="inactive_account"):
        store.commit("r1", staged, idle)
    typo = staged.rows.withColumn("category", F.lit("typo"))
    with pytest.raises(ValueError, match="category"):
        store.commit("r1", ingest.Staged(staged.statements, typo, staged.links), ingest.Config(config.accounts, categories=("tienda",)))
    assert store.manifest()["version"] == 0


def test_originals_backups_and_migration(spark, inbox, config, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    files = statements.discover(spark, f"file://{inbox}")
    staged = ingest.build(statements.read_statements(files), config)
    store.commit("r1", staged, config, files)
    assert store.originals().where("sound").count() == 2 and store.doctor(archived=True) == []
    with pytest.raises(PermissionError):
        store.archive(files.withColumn("file_sha256", F.lit("0" * 64)))
    one = next((tmp_path / "ledger" / "raw").glob("*.csv"))
    one.write_text("changed")
    assert store.doctor(archived=True) == ["originals altered"]
    one.unlink()
    assert store.doctor(archived=True) == ["originals missing"]
    for k in range(23):
        name = store.backup(f"t{k}")
    assert len([n for n in store.names(f"{store.root}/backups") if n.startswith("backup-")]) == 20 and store._sound(name)
    store.write_text(f"{store.root}/backups/{name}", "{}")
    assert "last backup does not verify" in store.doctor()
    store._publish(store.manifest() | {"schema": 1})
    assert store.migrate() == 2 and store.manifest()["migrated"] == [{"from": 1, "to": 2}]
    store._publish(store.manifest() | {"schema": 99})
    with pytest.raises(RuntimeError):
        store.transactions()


def test_content_digest_is_of_the_multiset(spark, monkeypatch):
    from tallyspark import store as module

    monkeypatch.setattr(module, "_FAN", 4)  # several rounds
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise("x").alias("t"))
    want = content_digest(df)
    assert content_digest(df.orderBy(F.desc("id")).repartition(5)) == want
    assert len({want, content_digest(df.union(df.limit(1))), content_digest(df.where("id > 0")), content_digest(df.withColumn("t", F.lit("x"))), content_digest(df.limit(0))}) == 5


def test_audit_of_two_months(spark):
    accounts = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "account_id string, active boolean")
    s = spark.createDataFrame([("a", "s1", "OK", 1, "2026-01-31"), ("a", "s2", "BLOCKED", 2, "2026-02-28"), ("b", "s3", "OK", 3, "2026-02-28")], "account_id string, statement_id string, result string, created_at int, period_end string").withColumn("period_end", F.to_date("period_end"))
    rows = s.select("account_id", F.col("period_end").alias("date_op"))
    look = lambda month: {r["account_id"]: (r["n_statements"], r["latest_result"], r["closed"]) for r in ledger.audit_month(accounts, s, rows, s, month).collect()}
    assert look("2026-01") == {"a": (1, "OK", True), "b": (0, None, False)}
    assert look("2026-02") == {"a": (1, "BLOCKED", False), "b": (1, "OK", True)}


def test_pool_of_the_interval_only(spark, inbox, config):
    first = stage(spark, inbox, config)
    old = first.rows.withColumn("transaction_id", F.concat(F.lit("old"), "transaction_id")).withColumn("account_id", F.lit("rio_debito"))
    far = old.withColumn("date_op", F.date_sub("date_op", 60))
    low, high = transfers.recent_pool(far, first.statements).count(), transfers.recent_pool(old, first.statements).count()
    assert (low, high) == (0, 5)


def test_text_documents_end_to_end(spark, config):
    text = """Periodo del 01/06/2026 al 30/06/2026 GBM GBM
01/06/2026 Deposito 500.00 1,500.00
02/06/2026 Compra 200.00 1,300.00"""
    docs = with_period(spark.createDataFrame([("d1", "gbm", text, "mar_debito", 100000, 130000)], "doc_id string, bank string, text string, account_id string, opening_minor long, closing_minor long"), "text")
    docs = issuers.summaries(docs)
    raw = ingest.from_documents(docs, parse_lines(text_lines(docs), docs))
    staged = ingest.build(raw, config)
    assert states(staged) == {"mar_debito": ("READY_TO_COMMIT", "OK", 0)}
    assert sorted(r["amount_minor"] for r in staged.rows.collect()) == [-20000, 50000]


def test_ocr_and_overlay(spark):
    a = spark.createDataFrame([("d", 1, "01/06/26 cafe 10.00 90.00", 80), ("d", 2, "02/06/26 pan 20.00 70.00", 80), ("d", 3, "ruido", 30), ("d", 4, "texto", 70)], "doc_id string, line_no int, line string, confidence int")
    b = spark.createDataFrame([("d", 1, "01/06/26 cofe 10.00 90.00", 60), ("d", 2, "02/06/26 pan 28.00 70.00", 60)], "doc_id string, line_no int, line string, confidence int")
    checked = statements.cross_check_ocr(a, b)
    assert {r["line_no"]: r["doubtful"] for r in checked.collect()} == {1: False, 2: True, 3: True, 4: False}
    rows = spark.createDataFrame([("d", "02/06 pan 20.00 70.00"), ("d", "cafe 10.00 90.00")], "doc_id string, raw_text string").withColumn("doubtful", F.lit(False))
    assert [r["doubtful"] for r in statements.flag_rows_of_doubtful_lines(rows, checked).orderBy("raw_text").collect()] == [True, False]
    words = spark.createDataFrame([(1, 10.0, 0.0, 50.0, "body", "a"), (1, 10.2, 40.0, 90.0, "mark", "WATER"), (1, 30.0, 0.0, 50.0, "body", "b"), (1, 60.0, 0.0, 9.0, "mark", "alone"), (1, 90.0, 0.0, 5.0, "body", "c")], "page int, top double, x0 double, x1 double, font string, text string")
    assert {r["text"] for r in statements.without_overlay(words).collect()} == {"a", "b", "alone", "c"}
    assert statements.decode_ebcdic("SALDO 1,234.56".encode("cp037")) == ("SALDO 1,234.56", True) and not statements.decode_ebcdic(b"abc")[1]
    u = spark.createDataFrame([("x" * 600,), ("x" * 600 + " 10.00",), ("short",)], "t string")
    assert [r[0] for r in u.select(statements.unusable_text(F.col("t"))).collect()] == [True, False, False]
