import json

import pytest

from tallyspark import cli

from .test_store import MAR, SOL


def test_a_month_by_commands(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "mar.csv").write_text(MAR, encoding="utf-8")
    (box / "sol.csv").write_text(SOL, encoding="utf-8")
    accounts = [{"account_id": a, "name": a, "institution": "Banco", "currency": "MXN", "type": "debito"} for a in ("mar_debito", "sol_ahorro")]
    (tmp_path / "c.json").write_text(json.dumps({"accounts": accounts, "rules": [], "key": "k"}))

    def do(*args):
        return cli.run(cli.parser().parse_args(["--root", f"file://{tmp_path}/ledger", "--config", str(tmp_path / "c.json"), *args]), spark)

    staged = do("ingest", f"file://{box}", "--run", "r1")
    assert set(staged["states"].values()) == {"READY_TO_COMMIT"} and staged["summary"]["n"] == 5
    first = do("review", "r1")[0]
    assert first["state"] == "READY_TO_COMMIT"
    with pytest.raises(SystemExit):
        do("commit", "r1")
    assert do("commit", "r1", "--confirm") == {"statements": 2, "transactions": 5, "links": 1}
    assert do("status")["transactions"] == 5 and do("doctor") == {"problems": []}
    assert [(r["account_id"], r["closed"]) for r in do("audit-month", "2026-06")] == [("mar_debito", True), ("sol_ahorro", True)]
    assert do("close-month", "2026-06") == {"closed": ["mar_debito", "sol_ahorro"], "pending": []}
    assert do("export", f"file://{tmp_path}/out")["n_rows"] == 5
    (tmp_path / "c.json").write_text(json.dumps({"accounts": accounts}))
    with pytest.raises(SystemExit):
        do("status")  # no key, no seals


def test_a_changed_staging_is_refused(spark, tmp_path):
    from tallyspark import staging
    from tallyspark.plans.ingest import Staged
    from tallyspark.store import Store

    store = Store(spark, f"file://{tmp_path}/ledger")
    df = spark.createDataFrame([("t1", "s1", "a", None, 5, "READY_TO_COMMIT")], "transaction_id string, statement_id string, account_id string, date_op date, amount_minor long, state string")
    staging.save(store, "r", Staged(df, df, df), b"k")
    assert staging.load(store, "r", b"k").rows.count() == 1
    df.write.mode("append").parquet(f"{store.root}/staging/run_id=r/rows")
    with pytest.raises(PermissionError):
        staging.load(store, "r", b"k")
