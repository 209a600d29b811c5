"""Staged runs on disk: three tables, a manifest and a seal over their contents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import untrusted
from .operators import categorize, ledger
from .plans.ingest import Staged
from .session import durable
from .store import Store

PARTS = ("statements", "rows", "links", "corrections")


def _path(store: Store, run_id: str, name: str) -> str:
    return f"{store.root}/staging/run_id={run_id}/{name}"


def save(store: Store, run_id: str, staged: Staged, key: bytes, overwrite: bool = False) -> dict:
    """Writes a run and its manifest: the seal, a summary and how many statements have which state; ``states`` tells each one's."""
    for name in PARTS:
        if getattr(staged, name) is not None:
            getattr(staged, name).write.mode("overwrite" if overwrite else "errorifexists").parquet(_path(store, run_id, name))
    kept = _read(store, run_id)
    summary = ledger.run_summary(kept.rows).first().asDict()
    counted = kept.statements.groupBy(F.coalesce("state", F.lit("none")).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["state"]: r["n"] for r in counted.collect()}  # a row per state
    manifest = {"run_id": run_id, "seal": store.seal(kept, key), "summary": summary, "state_counts": counts}
    artifacts(store, run_id, kept)
    store.write_text(_path(store, run_id, "manifest.json"), json.dumps(manifest, default=str, sort_keys=True))
    return manifest


def _read(store: Store, run_id: str) -> Staged:
    there = lambda name: store._fs.exists(store._path(_path(store, run_id, name)))
    return Staged(*(store.spark.read.parquet(_path(store, run_id, name)) if there(name) else None for name in PARTS))


def artifacts(store: Store, run_id: str, staged: Staged) -> None:
    """What a reviewer reads beside the sealed tables: the reconciliation of each statement, rows with flags, and a preview."""
    checks = [c for c in ("statement_id", "account_id", "state", "result", "opening_minor", "credits_minor", "debits_minor", "computed_closing_minor", "closing_minor", "diff_minor", "tolerance_minor", "n_transactions", "declared_count") if c in staged.statements.columns]
    staged.statements.select(*checks).write.mode("overwrite").json(_path(store, run_id, "reconciliation"))
    if "flags" in staged.rows.columns:
        odd = staged.rows.where(F.size("flags") > 0).select("transaction_id", "statement_id", F.concat_ws(",", "flags").alias("flags"), untrusted(F.col("raw_text")).alias("raw_text") if "raw_text" in staged.rows.columns else F.lit("").alias("raw_text"))
        odd.write.mode("overwrite").option("header", True).csv(_path(store, run_id, "exceptions"))
        preview(staged).write.mode("overwrite").option("header", True).csv(_path(store, run_id, "preview"))


def read_manifest(store: Store, run_id: str) -> dict:
    return json.loads(store.read_text(_path(store, run_id, "manifest.json")))


def states(store: Store, run_id: str) -> dict[str, str]:
    """The state of each statement of a run, for an answer that lists them all; nothing else holds them in the driver."""
    return {r["statement_id"]: r["state"] for r in _read(store, run_id).statements.select("statement_id", "state").toLocalIterator()}


def load(store: Store, run_id: str, key: bytes) -> Staged:
    """A staged run, refused if it was changed since it was sealed."""
    manifest = read_manifest(store, run_id)
    staged = _read(store, run_id)
    if store.seal(staged, key) != manifest["seal"]:
        raise PermissionError(f"run {run_id} differs from its seal")
    return staged


def preview(staged: Staged, n: int = 12) -> DataFrame:
    """The first rows of each statement, with its state."""
    rows = ledger.first_rows(staged.rows, "statement_id", ["date_op", "transaction_id"], n)
    return rows.join(staged.statements.select("statement_id", "state", "result"), "statement_id").select("statement_id", "state", "result", "date_op", "description_norm", "amount_minor", "currency", "category", F.concat_ws(",", "flags").alias("flags"))


def correct(store: Store, run_id: str, staged: Staged, corrections: list[tuple[str, str, str]], key: bytes, new_run: str) -> tuple[dict, list]:
    """A new staged run with corrections ``(transaction_id, field, value)``; the manifest and what was rejected."""
    df = store.spark.createDataFrame(corrections, "transaction_id string, field string, new_value string")
    rows, rejected = categorize.apply_corrections(staged.rows, df)
    turned = durable(rejected.select("transaction_id", "field", "reason"))
    before = F.when(F.col("field") == "category", F.col("category")).when(F.col("field") == "type", F.col("type")).otherwise(F.col("review_status"))
    done = df.join(turned.select("transaction_id", "field"), ["transaction_id", "field"], "left_anti").join(staged.rows.select("transaction_id", "category", "type", "review_status"), "transaction_id")
    log = done.select("transaction_id", "field", before.alias("old_value"), "new_value", F.lit("correction").alias("reason"))
    log = log if staged.corrections is None else staged.corrections.unionByName(log)
    return save(store, new_run, Staged(staged.statements, rows, staged.links, log), key), [tuple(r) for r in turned.collect()]


def open_spark(master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("tallyspark").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(master) if master else builder).getOrCreate()
