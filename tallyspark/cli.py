"""Command line: ``python -m tallyspark.cli --root DIR --config FILE COMMAND ...``.

The configuration is JSON: ``accounts`` (objects with account_id, name,
institution, currency, type, active, inverted), ``rules``, ``key`` (of the seals) and optionally
``holder``, ``tolerance_by_account``, ``row_cap``, ``bucket_cap``, ``window_days``.
Every command prints JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from collections.abc import Sequence

from pyspark.sql import functions as F

from . import staging
from .operators import ledger
from .plans import ingest
from .sources import statements
from .store import Store, approve, export


def load_config(spark, path: str) -> tuple[ingest.Config, bytes]:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    fields = ("account_id", "name", "institution", "currency", "type", "active", "inverted")
    rows = [tuple({"active": True, "inverted": False, **a}[k] for k in fields) for a in raw["accounts"]]
    accounts = spark.createDataFrame(rows, "account_id string, name string, institution string, currency string, type string, active boolean, inverted boolean")
    extra = {k: raw[k] for k in ("holder", "tolerance_by_account", "tolerance_by_currency", "default_tolerance", "row_cap", "bucket_cap", "window_days", "categories") if k in raw}
    if not raw.get("key"):
        raise SystemExit("the configuration has no key to seal staged runs with")
    hints = [(a["account_id"], h) for a in raw["accounts"] for h in a.get("match_hints", [])]
    if hints:
        extra["hints"] = spark.createDataFrame(hints, "account_id string, hint string")
    return ingest.Config(accounts, raw.get("rules", []), **extra), raw["key"].encode()


def files_of(spark, folder: str):
    return statements.discover(spark, folder)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspark")
    p.add_argument("--root", required=True)
    p.add_argument("--config", required=True)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **flags) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, nargs="+" if a == "corrections" else None)
        for flag, default in flags.items():
            c.add_argument(f"--{flag}", default=default, action="store_true" if default is False else "store")

    command("ingest", "folder", run=None, commit=False)
    command("review", "run")
    command("correct", "run", "corrections")
    command("approve", "run", "statement", "reason")
    command("commit", "run", confirm=False)
    command("rollback", "run", confirm=False)
    command("resolve", "transaction", "reason", confirm=False)
    command("audit-month", "month")
    command("close-month", "month")
    command("export", "folder")
    command("status")
    command("doctor")
    return p


def run(args: argparse.Namespace, spark=None) -> object:
    spark = spark or staging.open_spark(args.master)
    store = Store(spark, args.root)
    config, key = load_config(spark, args.config)
    fresh = lambda kind: f"{kind}_{uuid.uuid4().hex[:12]}"
    listed = lambda manifest: manifest | {"states": staging.states(store, manifest["run_id"])}
    if args.command in ("commit", "rollback", "resolve") and not args.confirm:
        raise SystemExit(f"{args.command} changes the ledger: give --confirm")
    match args.command:
        case "ingest":
            files = statements.read_statements(files_of(spark, args.folder))
            run_id = args.run or fresh("run")
            staged = ingest.build(files, config, store.transactions())
            manifest = staging.save(store, run_id, staged, key)
            if args.commit and set(manifest["state_counts"]) == {"READY_TO_COMMIT"}:
                manifest["committed"] = store.commit(run_id, staging.load(store, run_id, key), config, files_of(spark, args.folder))
            return listed(manifest)
        case "review":
            return [r.asDict() for r in staging.preview(staging.load(store, args.run, key)).collect()]
        case "correct":
            fixes = [tuple(c.split("=", 2)) for c in args.corrections]  # transaction=field=value
            new = fresh("run")
            manifest, rejected = staging.correct(store, args.run, staging.load(store, args.run, key), fixes, key, new)
            return listed(manifest) | {"rejected": rejected}
        case "approve":
            new = fresh("run")
            return listed(staging.save(store, new, approve(staging.load(store, args.run, key), args.statement, args.reason), key))
        case "commit":
            return store.commit(args.run, staging.load(store, args.run, key), config)
        case "rollback":
            store.rollback(args.run)
            return {"rolled_back": args.run}
        case "resolve":
            store.resolve(fresh("fix"), args.transaction, args.reason)
            return {"resolved": args.transaction}
        case "audit-month":
            checks = store.table("statements").select("account_id", "statement_id", "result", F.col("period_end").alias("created_at"), "period_end")
            found = ledger.audit_month(config.accounts, checks, store.transactions(), checks, args.month)
            return [r.asDict() for r in found.orderBy("account_id").collect()]
        case "close-month":
            closed, pending = store.close_month(fresh("close"), args.month)
            return {"closed": closed, "pending": pending}
        case "export":
            accounts = config.accounts.withColumn("institution_id", F.col("institution"))
            return export(store, accounts, accounts.select("institution_id", F.col("institution").alias("name")).distinct(), args.folder)
        case "status":
            return store.status()
        case "doctor":
            return {"problems": store.doctor()}


def main(argv: Sequence[str] | None = None) -> int:
    print(json.dumps(run(parser().parse_args(argv)), default=str, ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
