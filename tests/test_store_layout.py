"""Commits that only open what they can meet, and snapshots that tell a changed byte."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.plans.ingest import Staged
from tallyspark.store import BUCKETS, Store, byte_digests

ROW = "transaction_id string, statement_id string, account_id string, date_op date, amount_minor long, currency string, description_norm string, bank_ref string, fingerprint string, period_start date, period_end date, review_status string, dup_of string"


def staged(spark, run, months, accounts, links=()):
    rows = []
    for m in months:
        day = dt.date(2026, m, 5) if m else None
        for a in accounts:
            first = dt.date(2026, m or 1, 1)
            rows.append((f"{run}-{m}-{a}", f"{run}-{m}-{a}", a, day, 100, "MXN", f"pago {m}", "", f"fp-{run}-{m}-{a}", first, first + dt.timedelta(days=27), "ok", None))
    df = spark.createDataFrame(rows, ROW)
    s = df.select("statement_id", "account_id", F.lit("READY_TO_COMMIT").alias("state"), F.lit("OK").alias("result"), "period_start", "period_end")
    return Staged(s, df, spark.createDataFrame(list(links), "from_id string, to_id string, amount_minor long"))


def test_commits_open_only_their_own_months_and_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    accounts = [f"a{k}" for k in range(6)]
    store.commit("r0", staged(spark, "r0", [0, 1, 2, 3, 4], accounts))
    held = store.manifest()["catalog"]["r0"]["parts"]
    assert {p.split("/")[0] for p in held} == {"op_month=none", *(f"op_month=m2026-0{m}" for m in range(1, 5))}
    asked, whole = [], store.transactions
    store.transactions = lambda parts=None: (asked.append(parts), whole(parts))[1]
    for k in (1, 2):
        store.commit(f"r{k}", staged(spark, f"r{k}", [3], ["a1"]))
    assert [len(p) for p in asked] == [1, 1] and all(p.startswith("op_month=m2026-03/") for parts in asked for p in parts)
    store.transactions = whole
    # the second re-issue of one payment has two candidates, those of other months and accounts are none
    got = {r["transaction_id"]: (r["dup_of"], r["review_status"]) for r in store.transactions().where("account_id = 'a1' AND date_op = '2026-03-05'").collect()}
    assert got == {"r0-3-a1": ("r1-3-a1", "ok"), "r1-3-a1": ("r2-3-a1", "ok"), "r2-3-a1": (None, "ok")}
    near = store.near(spark.createDataFrame([("a1", dt.date(2026, 3, 5))], "account_id string, date_op date"))
    files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    opened, all_files = (len(store.table("transactions", parts=p).inputFiles()) for p in (near, None))
    assert len(near) == 1 and opened == 3 and all_files > 20 and files(spark.read.parquet(f"{store.root}/transactions"))
    wide = store.near(spark.createDataFrame([("a1", dt.date(2026, 3, 5))], "account_id string, date_op date"), 31, all_accounts=True)
    assert len(wide) == 3 * BUCKETS
    assert store.transactions({"op_month=m1999-01/bucket=0"}).count() == 0 and "op_month" not in store.transactions().columns


def test_links_meet_old_ends_of_other_accounts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    old = staged(spark, "o", [1], ["a", "b"])
    store.commit("o", Staged(old.statements, old.rows.withColumn("amount_minor", F.lit(-100).cast("long")), old.links))
    store.commit("n", staged(spark, "n", [1], ["c"], [("o-1-a", "n-1-c", 100), ("o-1-x", "n-1-c", 100)]))
    assert [(r["from_id"], r["to_id"]) for r in store.table("links").collect()] == [("o-1-a", "n-1-c")]


def test_a_changed_byte_of_equal_length_is_found(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ledger")
    store.commit("r", staged(spark, "r", [1], ["a"]))
    name = store.backup("by hand")
    assert store._sound(name) and store.doctor() == []
    target = next((tmp_path / "ledger" / "audit" / "run_id=r").glob("part-*.parquet"))
    body = bytearray(target.read_bytes())
    body[len(body) // 2] ^= 1
    target.write_bytes(bytes(body))
    assert not store._sound(name) and store.doctor() == ["last backup does not verify"]
    body[len(body) // 2] ^= 1
    target.write_bytes(bytes(body))
    assert store._sound(name)


def test_checksums_depend_on_blocks_names_and_groups(spark, tmp_path, monkeypatch):
    (tmp_path / "one").write_bytes(b"x" * 100)
    (tmp_path / "two").write_bytes(b"")
    files = [("g", f"{tmp_path}/one", 100), ("g", f"{tmp_path}/two", 0), ("h", f"{tmp_path}/one", 100)]
    a = byte_digests(spark, files)
    assert set(a) == {"g", "h"} and a["g"] != a["h"] and a == byte_digests(spark, files[::-1]) and byte_digests(spark, []) == {}
    (tmp_path / "one").write_bytes(b"x" * 99 + b"y")
    assert byte_digests(spark, files)["h"] != a["h"]
