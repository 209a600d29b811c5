"""The ledger as tools for other programs: JSON-RPC messages, one per line, over standard input and output.

``python -m tallyspark.tools --root URI --config FILE --inbox FOLDER``.  Tools call the
same functions as the command line.  Imports are previews, changes of the ledger
need ``confirm``, paths stay below the inbox, accounts are masked, and every result
passes through ``harmless``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import staging
from .cli import load_config
from .functions.text import harmless
from .operators import ledger
from .plans import ingest
from .sources import statements
from .store import Store, approve, export

# Fixed values of the protocol.
PROTOCOL = "2024-11-05"
UNKNOWN_METHOD, NOT_JSON = -32601, -32700


class ToolError(ValueError):
    """A wrong use of a tool: it is told to the caller as a result, not as a failure of the protocol."""


def inside(root: str, path: str) -> str:
    """The real path of ``path``, which has to lie in ``root``, links resolved."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and os.path.commonpath([base, full]) != base:
        raise ToolError(f"path outside the inbox: {path}")
    return full


@dataclass
class Tool:
    description: str
    arguments: dict[str, str]
    optional: tuple[str, ...]
    run: Callable

    def schema(self) -> dict:
        return {"type": "object", "properties": {k: {"type": t} for k, t in self.arguments.items()}, "required": [k for k in self.arguments if k not in self.optional], "additionalProperties": False}


def fresh(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


def masked(account: str | None) -> str | None:
    """The beginning of an account's name and its last four characters."""
    return f"{account[:3]}••••{account[-4:]}" if account and len(account) > 8 else account


class Ledger:
    """What the tools work on."""

    def __init__(self, spark: SparkSession, root: str, config_file: str, inbox: str):
        self.spark, self.store, self.inbox = spark, Store(spark, root), inbox
        self.config, self.key = load_config(spark, config_file)
        self.tools = self._tools()

    # --- reading

    def status(self) -> dict:
        return {"root": self.store.root, "schema": self.store.manifest()["schema"], "counts": self.store.status(), "export": self.store.export_state(), "export_schema": ledger.CONTRACT_VERSION}

    def list_inbox(self) -> dict:
        found = sorted(os.listdir(self.inbox)) if os.path.isdir(self.inbox) else []
        return {"files": [n for n in found if n.lower().rsplit(".", 1)[-1] in statements.EXTENSIONS]}

    def preview(self, path: str, period: str | None = None) -> dict:
        folder = inside(self.inbox, path)
        if not os.path.exists(folder):
            raise ToolError(f"nothing to import in {path}")
        files = statements.discover(self.spark, f"file://{folder}")
        run_id = fresh("run")
        manifest = staging.save(self.store, run_id, ingest.build(statements.read_statements(files), self.config, self.store.transactions()), self.key)
        return self._told(manifest) | {"period": period}

    def get_run(self, run_id: str) -> dict:
        return self._told(staging.read_manifest(self.store, run_id))

    def _told(self, manifest: dict) -> dict:
        return {k: v for k, v in manifest.items() if k != "seal"} | {"states": staging.states(self.store, manifest["run_id"])}

    def review_queue(self, run_id: str) -> dict:
        waiting = self._staged(run_id).statements.where("state <> 'READY_TO_COMMIT'").select("statement_id", "account_id", "state", "result", "blocks").collect()  # one per file
        return {"run_id": run_id, "review_queue": [{"statement_id": r["statement_id"], "account": masked(r["account_id"]), "state": r["state"], "why": [*r["blocks"], f"reconciliation_{(r['result'] or 'none').lower()}"]} for r in waiting]}

    def audit_month(self, month: str) -> dict:
        table = self.store.table("statements")
        if table is None:
            return {"month": month, "accounts": []}
        checks = table.select("account_id", "statement_id", "result", F.col("period_end").alias("created_at"), "period_end")
        found = ledger.audit_month(self.config.accounts, checks, self.store.transactions(), checks, month).orderBy("account_id").collect()
        return {"month": month, "accounts": [r.asDict() for r in found]}

    # --- changing

    def _staged(self, run_id: str) -> ingest.Staged:
        try:
            return staging.load(self.store, run_id, self.key)
        except PermissionError as e:
            raise ToolError(str(e)) from None

    def correct(self, run_id: str, corrections: list[dict]) -> dict:
        fixes = [(c.get("transaction_id"), c.get("field"), str(c.get("value"))) for c in corrections]
        new = fresh("run")
        _, rejected = staging.correct(self.store, run_id, self._staged(run_id), fixes, self.key, new)
        return {"run_id": new, "applied": len(fixes) - len(rejected), "rejected": [{"transaction_id": t, "field": f, "why": why} for t, f, why in rejected]}

    def approve(self, run_id: str, statement_id: str, reason: str) -> dict:
        new = fresh("run")
        staging.save(self.store, new, approve(self._staged(run_id), statement_id, reason), self.key)
        return {"run_id": new, "statement_id": statement_id, "state": "READY_TO_COMMIT", "reason": reason}

    def commit(self, run_id: str, confirm: bool = False) -> dict:
        self._confirmed("commit", confirm)
        return {"run_id": run_id, "committed": True} | self.store.commit(run_id, self._staged(run_id), self.config)

    def rollback(self, import_id: str, confirm: bool = False) -> dict:
        self._confirmed("rollback", confirm)
        self.store.rollback(import_id)
        return {"import_id": import_id, "rolled_back": True}

    def resolve(self, transaction_id: str, reason: str, confirm: bool = False) -> dict:
        self._confirmed("resolving a quarantine", confirm)
        self.store.resolve(fresh("fix"), transaction_id, reason)
        return {"transaction_id": transaction_id, "review_status": "ok", "reason": reason}

    def close_month(self, month: str) -> dict:
        closed, pending = self.store.close_month(fresh("close"), month)
        return {"month": month, "closed": closed, "pending": pending, "all_closed": not pending}

    def refresh_export(self) -> dict:
        accounts = self.config.accounts.withColumn("institution_id", F.col("institution"))
        return export(self.store, accounts, accounts.select("institution_id", F.col("institution").alias("name")).distinct(), f"{self.store.root}/exports")

    @staticmethod
    def _confirmed(what: str, confirm: bool) -> None:
        if confirm is not True:
            raise ToolError(f"{what} needs an explicit confirm=true")

    def _tools(self) -> dict[str, Tool]:
        text, yes = "string", "boolean"
        run, month = {"run_id": text}, {"month": text}
        preview = Tool("Read, reconcile and stage files of the inbox; nothing is committed.", {"path": text, "period": text}, ("period",), self.preview)
        # The names that callers know the tools by.
        return {
            "finance_system_status": Tool("Counts, schema and export state of the ledger.", {}, (), self.status),
            "finance_list_inbox": Tool("Files that wait in the inbox.", {}, (), self.list_inbox),
            "finance_preview_import": preview,
            "finance_ingest_statement": preview,
            "finance_get_run": Tool("The manifest of a staged run.", run, (), self.get_run),
            "finance_get_review_queue": Tool("Statements of a run that need a review, and why.", run, (), self.review_queue),
            "finance_apply_corrections": Tool("Correct category, type or review status of staged movements, as a new run.", run | {"corrections": "array"}, (), self.correct),
            "finance_approve": Tool("Approve a reviewed statement with a reason, as a new run.", run | {"statement_id": text, "reason": text}, (), self.approve),
            "finance_commit_import": Tool("Commit a staged run; needs confirm.", run | {"confirm": yes}, ("confirm",), self.commit),
            "finance_rollback_import": Tool("Take a commit back; needs confirm.", {"import_id": text, "confirm": yes}, ("confirm",), self.rollback),
            "finance_audit_month": Tool("Coverage and verdicts of a month.", month, (), self.audit_month),
            "finance_close_month": Tool("Close a month for the accounts that are ready.", month, (), self.close_month),
            "finance_refresh_excel": Tool("Write the export and its contract.", {}, (), self.refresh_export),
            "finance_resolve_quarantine": Tool("Make a quarantined movement valid with a reason; needs confirm.", {"transaction_id": text, "reason": text, "confirm": yes}, ("confirm",), self.resolve),
        }

    def call(self, name: str, arguments: dict) -> object:
        tool = self.tools.get(name)
        if tool is None:
            raise ToolError(f"unknown tool: {name}")
        missing, unknown = [a for a in tool.schema()["required"] if a not in arguments], [a for a in arguments if a not in tool.arguments]
        if missing or unknown:
            raise ToolError(f"{name}: missing {missing}, unknown {unknown}")
        return harmless(tool.run(**arguments))


def answer(book: Ledger, message: dict) -> dict | None:
    """The reply to one message; none to a notification."""
    number, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    reply = lambda result: {"jsonrpc": "2.0", "id": number, "result": result}
    if method == "initialize":
        return reply({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tallyspark", "version": "1"}})
    if method == "tools/list":
        return reply({"tools": [{"name": n, "description": t.description, "inputSchema": t.schema()} for n, t in book.tools.items()]})
    if method == "tools/call":
        try:
            said, wrong = json.dumps(book.call(params.get("name"), params.get("arguments") or {}), ensure_ascii=False, default=str), False
        except Exception as e:  # whatever a tool raises is told to the caller; the server goes on
            said, wrong = harmless(str(e) if isinstance(e, (ValueError, PermissionError)) else f"internal error: {type(e).__name__}"), True
        return reply({"content": [{"type": "text", "text": said}]} | ({"isError": True} if wrong else {}))
    if number is None:
        return None
    return {"jsonrpc": "2.0", "id": number, "error": {"code": UNKNOWN_METHOD, "message": f"unknown method: {method}"}}


def serve(book: Ledger, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(book, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": NOT_JSON, "message": "not JSON"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyspark.tools")
    for flag in ("--root", "--config", "--inbox"):
        p.add_argument(flag, required=True)
    p.add_argument("--master")
    args = p.parse_args(argv)
    serve(Ledger(staging.open_spark(args.master), args.root, args.config, args.inbox), sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
