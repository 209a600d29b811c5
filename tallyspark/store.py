"""The ledger store: immutable run folders, append-only events, one manifest.

A commit writes a run's tables into ``<root>/<table>/run_id=<id>/`` and then
publishes ``manifest-<version>.json``, which lists the runs that are visible; it is
written aside and renamed, so it appears whole and only if no other writer was
first.  Readers only see listed runs, and what a failed try left is written over.
The manifest also tells which tables and which parts a run has and the checksum of its bytes.  Movements are laid out by
month and account bucket, so a commit only opens the parts that its own accounts
and days can meet, however long the ledger is.
Superseding a row, resolving a quarantined one and closing a month are events of a
run, so rolling a run back - publishing a manifest without it - takes them back.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import month_key
from .functions.money import estimate_minor
from .operators import duplicates, ledger, transfers, validate
from .operators.validate import may_approve
from .plans.ingest import Config, Staged
from .session import durable
from .sources.statement_csv import filesystem

TABLES = ("statements", "transactions", "links", "events", "audit", "quarantine", "corrections", "institutions", "accounts")
SCHEMA_VERSION = 2
#: Snapshots that are kept.
KEEP_BACKUPS = 20
_EVENTS = "kind string, key string, value string, reason string, at timestamp"
_CORRECTIONS = "transaction_id string, field string, old_value string, new_value string, reason string"
#: Digests that are hashed together.
_FAN = 4096
#: Accounts are dealt to so many folders of a month, which bounds the parts of a commit.
BUCKETS = 8
#: The ends of a link are no further apart.
LINK_DAYS = 31
#: Bytes that are hashed at a time.
_BLOCK = 16 << 20


def stored_under(day: Column, account: Column) -> tuple[Column, Column]:
    """Month and bucket that a movement is stored under; rows without a day have a month of their own."""
    return F.coalesce(F.date_format(day, "'m'yyyy-MM"), F.lit("none")).alias("op_month"), F.pmod(F.xxhash64(account), F.lit(BUCKETS)).cast("int").alias("bucket")


def _block_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, offset, length in zip(frame["path"], frame["offset"], frame["length"]):
            system, at = filesystem(path)
            with system.open_input_file(at) as file:
                file.seek(int(offset))
                out.append(hashlib.sha256(file.read(int(length))).hexdigest())
        yield pd.DataFrame({"group": frame["group"], "path": frame["path"], "offset": frame["offset"], "h": out})


def byte_digests(spark: SparkSession, files: list[tuple[str, str, int]]) -> dict[str, str]:
    """A checksum per group of files ``(group, path, length)``: blocks are hashed by the executors, blocks make a file's hash, and files, by name, their group's."""
    blocks = [(g, p, low, min(_BLOCK, size - low)) for g, p, size in files for low in range(0, max(size, 1), _BLOCK)]
    if not blocks:
        return {}
    df = spark.createDataFrame(blocks, "group string, path string, offset long, length long").repartition(1 + sum(size for *_, size in files) // (4 * _BLOCK))
    hashed = df.mapInPandas(_block_digests, "group string, path string, offset long, h string")
    whole = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256).alias("h")
    named = hashed.groupBy("group", "path").agg(whole("offset")).withColumn("h", F.sha2(F.concat_ws("|", F.regexp_extract("path", r"([^/]+)$", 1), "h"), 256))
    return {r["group"]: r["h"] for r in named.groupBy("group").agg(whole("path")).collect()}  # a row per run and table


def content_digest(df: DataFrame) -> str:
    """SHA-256 over the rows of a table, whatever their order: sorted row hashes are hashed group by group, in as many rounds as it takes."""
    cols = sorted(df.columns)
    rows = durable(df.select(F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}), 256)).alias("h")))
    listed = F.lower(F.hex(F.array_join(F.array_sort(F.collect_list("h")).cast("array<string>"), "")))  # hashes travel as bytes and are hashed as text
    n, rounds = rows.count(), 0
    total = n
    while n > 1:
        depth = 0
        while n > _FAN * 16**depth:
            depth += 1
        rows = rows.groupBy(F.substring(F.hex("h"), 1, depth).alias("g")).agg(F.unhex(F.sha2(listed, 256)).alias("h")).select("h")
        rows, rounds = durable(rows), rounds + 1
        n = rows.count()
    last = rows.first()
    return hashlib.sha256(f"{','.join(cols)}|{total}|{last['h'].hex() if last else ''}".encode()).hexdigest()


class Busy(RuntimeError):
    """Another writer published first; nothing was changed and the call can be repeated."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests and contracts are a few hundred bytes each and are handled by the driver

    def read_text(self, where: str) -> str:
        stream = self._fs.open(self._path(where))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, where: str, text: str, replace: bool = True) -> None:
        """A whole file or none; without ``replace`` an existing one is not touched and ``Busy`` is raised."""
        jvm, target = self.spark._jvm, self._path(where)
        draft = self._path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE if replace else options.NONE
        qualified = [self._fs.makeQualified(p) for p in (draft, target)]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[1].toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(*qualified, how)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Busy(f"{where} exists") from None
            raise

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.names(self.root) if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "schema": SCHEMA_VERSION, "runs": [], "rolled_back": []}
        found = json.loads(self.read_text(f"{self.root}/manifest-{versions[-1]}.json"))
        if found["schema"] > SCHEMA_VERSION:
            raise RuntimeError(f"the ledger has schema {found['schema']}, this version reads up to {SCHEMA_VERSION}")
        return found

    def migrate(self) -> int:
        """Brings the manifest to this schema, after a backup; runs of older schemas lack tables and columns, which reads fill with nulls."""
        manifest = self.manifest()
        if manifest["version"] and manifest["schema"] < SCHEMA_VERSION:
            self.backup(f"schema-{manifest['schema']}")
            self._publish(manifest | {"schema": SCHEMA_VERSION, "migrated": [*manifest.get("migrated", []), {"from": manifest["schema"], "to": SCHEMA_VERSION}]})
        return SCHEMA_VERSION

    def _publish(self, manifest: dict) -> None:
        manifest = manifest | {"version": manifest["version"] + 1}
        self.write_text(f"{self.root}/manifest-{manifest['version']}.json", json.dumps(manifest, sort_keys=True), replace=False)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Paths and lengths of a folder's data files, at any depth."""
        out, found = [], self._fs.listFiles(self._path(folder), True)
        while found.hasNext():
            status = found.next()
            if status.getPath().getName().startswith("part-"):
                out.append((status.getPath().toString(), status.getLen()))
        return sorted(out)

    def _catalog(self, run_id: str) -> dict:
        """Of a run that was just written: its tables, the parts of its movements, and checksums of the bytes as they read back."""
        tables = [t for t in TABLES if self._fs.exists(self._path(f"{self.root}/{t}/run_id={run_id}"))]
        files = [(t, path, size) for t in tables for path, size in self._files(f"{self.root}/{t}/run_id={run_id}")]
        parts = {tuple(path.split("/")[-3:-1]) for t, path, _ in files if t == "transactions" and path.split("/")[-3].startswith("op_month=")}
        return {"tables": tables, "parts": sorted("/".join(p) for p in parts), "digests": byte_digests(self.spark, files)}

    def table(self, name: str, runs: Sequence[str] | None = None, parts: set[str] | None = None) -> DataFrame | None:
        """The rows of all visible runs; null before the first.  ``parts`` limits movements to some months and buckets."""
        manifest = self.manifest()
        catalog, laid, plain = manifest.get("catalog", {}), [], []
        for run in manifest["runs"] if runs is None else runs:
            folder, known = f"{self.root}/{name}/run_id={run}", catalog.get(run)
            if known and name not in known["tables"] or not known and not self._fs.exists(self._path(folder)):
                continue
            if not known or name != "transactions" or not known["parts"]:
                plain.append(folder)
            else:
                laid += [folder] if parts is None else [f"{folder}/{p}" for p in known["parts"] if p in parts]
        read = lambda found: self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", "true").parquet(*found)
        out = [read(found) for found in (laid, plain) if found]
        if not out:
            first = next((run for run in reversed(manifest["runs"] if runs is None else runs) if name in catalog.get(run, {}).get("tables", ())), None) if parts is not None else None
            return self.table(name, [first]).limit(0) if first else None
        return out[0].drop("op_month", "bucket") if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True).drop("op_month", "bucket")

    def _events(self, kind: str) -> DataFrame | None:
        events = self.table("events")
        return ledger.latest_by(events.where(F.col("kind") == kind), ["key"], ["at", "value"]) if events is not None else None

    def transactions(self, parts: set[str] | None = None) -> DataFrame | None:
        """Visible rows with superseding and resolution applied; of some months and buckets only, if ``parts`` are given."""
        rows = self.table("transactions", parts=parts)
        if rows is None:
            return None
        for kind, column in (("supersede", "dup_of"), ("resolve", "review_status")):
            last = self._events(kind)
            if last is not None:
                rows = rows.join(last.select(F.col("key").alias("transaction_id"), F.col("value").alias("_v")), "transaction_id", "left").withColumn(column, F.coalesce("_v", column)).drop("_v")
        return rows

    def quarantine(self) -> DataFrame | None:
        """``(statement_id, account_id, month, reason, n, amount_minor)`` of statements that were held back and not committed since."""
        held = self.table("quarantine")
        if held is None:
            return None
        last = ledger.latest_by(held.drop("run_id"), ["statement_id", "month"], ["at", "reason"]).drop("at")
        return last.join(self.table("statements").select("statement_id").distinct(), "statement_id", "left_anti")

    def closed_months(self) -> DataFrame | None:
        """``(account_id, month)`` that are closed."""
        last = self._events("close")
        if last is None:
            return None
        return last.where("value = 'closed'").select(F.split("key", r"\|")[0].alias("account_id"), F.split("key", r"\|")[1].alias("month"))

    def contents(self, staged: Staged) -> str:
        """What a seal is made of, whatever the order of rows; for several keys it is read once."""
        parts = [staged.statements, staged.rows, staged.links, *([staged.corrections] if staged.corrections is not None else [])]
        return "\n".join(content_digest(df) for df in parts)

    def sign(self, contents: str, key: bytes) -> str:
        if not key:
            raise ValueError("a seal needs a key")
        return hmac.new(key, contents.encode(), hashlib.sha256).hexdigest()

    def seal(self, staged: Staged, key: bytes) -> str:
        """HMAC-SHA256 of a staged run's contents."""
        self.sign("", key)  # a missing key is told before anything is read
        return self.sign(self.contents(staged), key)

    def _counts(self, run_id: str) -> dict:
        count = lambda name: df.count() if (df := self.table(name, [run_id])) is not None else 0
        return {name: count(name) for name in ("statements", "transactions", "links")}

    def _write(self, run_id: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            where = f"{self.root}/{name}/run_id={run_id}"  # a failed try of this run may have left a part
            if name == "transactions":
                df = df.select("*", *stored_under(F.col("date_op"), F.col("account_id")))
                df.hint("rebalance", "op_month", "bucket").write.mode("overwrite").partitionBy("op_month", "bucket").parquet(where)
                if not self._files(where):  # no rows: the schema is kept
                    df.limit(0).drop("op_month", "bucket").coalesce(1).write.mode("overwrite").parquet(where)
            else:
                df.write.mode("overwrite").parquet(where)

    def _with_run(self, manifest: dict, run_id: str) -> dict:
        return manifest | {"runs": [*manifest["runs"], run_id], "catalog": manifest.get("catalog", {}) | {run_id: self._catalog(run_id)}}

    def near(self, rows: DataFrame, days: int = 0, all_accounts: bool = False) -> set[str]:
        """The parts in which movements of the accounts and months of ``rows`` may lie, or of all accounts up to ``days`` away; a month has ``BUCKETS`` at most."""
        spread = F.array_distinct(F.array(*[F.date_add("date_op", k) for k in sorted({-days, 0, days} | set(range(-days, days, 28)))]))
        months = rows.where("date_op IS NOT NULL").select(F.explode(spread).alias("date_op"), "account_id")
        found = months.select(*stored_under(F.col("date_op"), F.col("account_id"))).distinct().collect()
        buckets = range(BUCKETS) if all_accounts else ()
        return {f"op_month={r['op_month']}/bucket={b}" for r in found for b in (buckets or (r["bucket"],))}

    def commit(self, run_id: str, staged: Staged, config: Config | None = None, originals: DataFrame | None = None) -> dict:
        """Adds a run and returns how many statements, transactions and links it has; repeating a finished run only returns that.

        Statements that were committed before are skipped.  Those that are not ready,
        or touch a closed month, are held back: their rows stay out and a quarantine
        record tells month, number and amount; committing them later, once they were
        approved, clears it.  With ``config`` ready statements are validated again and
        any problem stops the commit; ``originals`` (path, content, file_sha256) are
        archived first.  Rows that correct rows of an overlapping statement
        supersede them.  Links are checked again against what is committed.
        """
        manifest = self.manifest()
        if run_id in manifest["runs"]:
            return self._counts(run_id)
        if run_id in manifest["rolled_back"]:
            raise ValueError(f"run {run_id} was rolled back")
        if config is not None:
            ready_now = staged.statements.where("state = 'READY_TO_COMMIT'")
            problems = validate.commit_problems(ready_now, staged.rows, config.accounts, tuple(config.categories)).limit(20).collect()  # a few, for the message
            if problems:
                raise ValueError("; ".join(f"{r['statement_id']}: {r['problem']}" for r in problems))
        if originals is not None:
            self.archive(originals.join(staged.statements.where("state = 'READY_TO_COMMIT'").select("file_sha256").distinct(), "file_sha256", "left_semi"))
        if manifest["version"]:
            self.backup(f"commit-{run_id}")
        statements = staged.statements.drop(*[c for c in ("meta", "warnings") if c in staged.statements.columns])
        known = self.table("statements")
        fresh = duplicates.not_committed(statements, known) if known is not None else statements
        closed = self.closed_months()
        if closed is not None:
            starts = fresh.where("period_start IS NOT NULL").select("statement_id", "account_id", F.col("period_start").alias("date_op")) if "period_start" in fresh.columns else None
            touched = ledger.touches_closed_month(staged.rows, closed)
            touched = (touched.union(ledger.touches_closed_month(starts, closed)) if starts is not None else touched).distinct().withColumn("_c", F.lit(True))
            fresh = fresh.join(touched, "statement_id", "left")
        else:
            fresh = fresh.withColumn("_c", F.lit(None).cast("boolean"))
        reason = F.when(F.col("_c"), F.lit("month_closed")).when(F.col("state") != "READY_TO_COMMIT", F.concat_ws(";", F.col("state"), *(["blocks"] if "blocks" in fresh.columns else [])))
        fresh = durable(fresh.withColumn("_reason", reason).drop("_c"))
        entered, held = fresh.where("_reason IS NULL").drop("_reason"), fresh.where("_reason IS NOT NULL").select("statement_id", F.col("_reason").alias("reason"))
        mine = staged.rows.where("dup_of IS NULL").join(entered.select("statement_id"), "statement_id", "left_semi")
        mine = durable(mine)
        rows = mine.withColumn("created_at", F.current_timestamp())
        old = self.transactions(self.near(mine)) if manifest["runs"] else None
        events = self.spark.createDataFrame([], _EVENTS)
        if old is not None:
            versions = durable(duplicates.prior_versions(rows, old))
            rows = rows.join(versions.select("transaction_id", "ambiguous"), "transaction_id", "left").withColumn("review_status", F.when(F.col("ambiguous"), "cuarentena").otherwise(F.col("review_status"))).drop("ambiguous")
            won = versions.where("supersedes IS NOT NULL")
            events = events.union(won.select(F.lit("supersede"), "supersedes", "transaction_id", F.lit("corrected statement"), F.current_timestamp()))
        rows = durable(rows)
        pool = rows.withColumn("is_new", F.lit(True))
        if old is not None and not staged.links.isEmpty():
            old = self.transactions(self.near(mine, LINK_DAYS, all_accounts=True))
            pool = pool.unionByName(old.where("dup_of IS NULL").withColumn("is_new", F.lit(False)), allowMissingColumns=True)
        links = transfers.revalidate_links(staged.links, pool)
        waiting = staged.rows.where("dup_of IS NULL").join(held, "statement_id")
        raw = F.col("raw_text") if "raw_text" in waiting.columns else F.lit(None).cast("string")
        fallback = "period_start" if "period_start" in waiting.columns else "date_op"
        quarantined = ledger.quarantine_by_month(waiting.withColumn("estimate_minor", estimate_minor(raw)), fallback).join(held, "statement_id").join(staged.statements.select("statement_id", "account_id"), "statement_id")
        given = staged.corrections if staged.corrections is not None else self.spark.createDataFrame([], _CORRECTIONS)
        said = self.spark.createDataFrame([("commit", run_id)], "action string, subject string").union(entered.select(F.lit("commit_statement"), "statement_id")).union(held.select(F.concat(F.lit("held: "), "reason"), "statement_id"))
        self._write(run_id, {
            "statements": entered, "transactions": rows, "links": links, "events": events, "audit": said.withColumn("at", F.current_timestamp()),
            "quarantine": quarantined.select("statement_id", "account_id", "month", "reason", F.col("n").cast("long").alias("n"), F.col("total_minor").cast("long").alias("amount_minor"), F.current_timestamp().alias("at")),
            "corrections": given.join(rows.select("transaction_id"), "transaction_id", "left_semi"),
        })
        if config is not None:
            self._write(run_id, self._new_dimensions(config.accounts))
        self._publish(self._with_run(manifest, run_id))
        return self._counts(run_id)

    def _new_dimensions(self, accounts: DataFrame) -> dict[str, DataFrame]:
        """Accounts and institutions that the ledger does not have yet."""
        fresh = {"accounts": accounts, "institutions": accounts.select("institution").distinct()}
        for name, key in (("accounts", "account_id"), ("institutions", "institution")):
            seen = self.table(name)
            if seen is not None:
                fresh[name] = fresh[name].join(seen.select(key), key, "left_anti")
        return fresh

    def months(self) -> DataFrame | None:
        """``(account_id, month, result)``: the worst verdict on the committed statements that end in each month."""
        statements = self.table("statements")
        return ledger.month_verdicts(statements) if statements is not None else None

    def rollback(self, run_id: str) -> None:
        """Takes a run and its events back; refused if it touches a closed month."""
        manifest = self.manifest()
        if run_id not in manifest["runs"]:
            raise ValueError(f"run {run_id} is not committed")
        closed, rows = self.closed_months(), self.table("transactions", [run_id])
        if closed is not None and rows is not None and not ledger.touches_closed_month(rows, closed).isEmpty():
            raise ValueError(f"run {run_id} has rows in a closed month")
        self.backup(f"rollback-{run_id}")
        self._publish(manifest | {"runs": [r for r in manifest["runs"] if r != run_id], "rolled_back": [*manifest["rolled_back"], run_id]})

    def _record(self, run_id: str, events: list[tuple[str, str, str, str]]) -> None:
        manifest = self.manifest()
        if run_id in manifest["runs"]:
            return
        df = self.spark.createDataFrame(events, "kind string, key string, value string, reason string").withColumn("at", F.current_timestamp())
        self._write(run_id, {"events": df, "audit": df.select(F.col("kind").alias("action"), F.col("key").alias("subject"), "at")})
        self._publish(self._with_run(manifest, run_id))

    def resolve(self, run_id: str, transaction_id: str, reason: str) -> None:
        """A quarantined row becomes valid, by hand and with a reason, in an open month."""
        row = self.transactions().where(F.col("transaction_id") == transaction_id).select("review_status", "account_id", month_key(F.col("date_op")).alias("month")).first()
        if row is None or row["review_status"] != "cuarentena" or not reason.strip():
            raise ValueError("no such row in quarantine, or no reason")
        closed = self.closed_months()
        if closed is not None and not closed.where((F.col("account_id") == row["account_id"]) & (F.col("month") == row["month"])).isEmpty():
            raise ValueError("the month is closed")
        self._record(run_id, [("resolve", transaction_id, "ok", reason)])

    def held_back(self) -> DataFrame:
        """``(account_id, month, n, amount_minor)`` of held statements and of committed rows in quarantine."""
        held = self.quarantine()
        none = self.spark.createDataFrame([], "account_id string, month string, n long, amount_minor long")
        return ledger.quarantine_totals(held if held is not None else none, self.transactions())

    def close_month(self, run_id: str, month: str) -> tuple[list[str], list[str]]:
        """Closes the accounts whose worst verdict of the month is OK and that have nothing held back there; a month needs a statement."""
        waiting = self.held_back().where(F.col("month") == month)
        months = self.months().where(F.col("month") == month)
        found = ledger.close_status(months, waiting).collect()  # one row per account
        closed = sorted(r["account_id"] for r in found if r["status"] == "closed")
        pending = {r["account_id"] for r in found if r["status"] == "pending"} | {r["account_id"] for r in waiting.select("account_id").distinct().collect() if r["account_id"]}
        if closed:
            self._record(run_id, [("close", f"{a}|{month}", "closed", "close_month") for a in closed])
        return closed, sorted(pending - set(closed))

    def set_export_state(self, state: str, reason: str = "") -> None:
        """Marks the ledger as it is now as exported or not; the machine of states has to allow it."""
        now = self.manifest()["version"]
        known = self.export_state()
        if state not in validate.TRANSITIONS[known]:
            if known == state:
                return
            raise ValueError(f"{known} can't become {state}")
        self.write_text(f"{self.root}/export-state.json", json.dumps({"version": now, "state": state, "reason": reason}))

    def export_state(self) -> str:
        """``COMMITTED`` after every change of the ledger, until it is exported."""
        if not self._fs.exists(self._path(f"{self.root}/export-state.json")):
            return "COMMITTED"
        found = json.loads(self.read_text(f"{self.root}/export-state.json"))
        return found["state"] if found["version"] == self.manifest()["version"] else "COMMITTED"

    # --- snapshots and originals

    def fingerprint(self, manifest: dict) -> dict:
        """Checksums over the bytes of all visible runs' files, read again by the executors."""
        files = [(f"{t}/{run}", path, size) for run in manifest["runs"] for t in TABLES if self._fs.exists(self._path(f"{self.root}/{t}/run_id={run}")) for path, size in self._files(f"{self.root}/{t}/run_id={run}")]
        return byte_digests(self.spark, files)

    def backup(self, tag: str) -> str:
        """A snapshot: the manifest with a checksum of the bytes of every run; the newest ``KEEP_BACKUPS`` stay.

        Files never change once their run is published, so the checksums are those
        that were made of the bytes when the run was written, and a snapshot costs the
        same however long the ledger is.  ``restore`` and ``doctor`` read all bytes again.
        """
        manifest = self.manifest()
        known = {f"{t}/{run}": h for run in manifest["runs"] for t, h in manifest.get("catalog", {}).get(run, {}).get("digests", {}).items()}
        older = [run for run in manifest["runs"] if run not in manifest.get("catalog", {})]  # of a schema without checksums
        body = json.dumps({"tag": tag, "manifest": manifest, "files": known | (self.fingerprint(manifest | {"runs": older}) if older else {})}, sort_keys=True)
        folder = f"{self.root}/backups"
        kept = [n for n in self.names(folder) if n.startswith("backup-")]
        name = f"backup-{(int(kept[-1].split('-')[1]) if kept else 0) + 1:09d}-{hashlib.sha256(body.encode()).hexdigest()}.json"
        self._fs.mkdirs(self._path(folder))
        self.write_text(f"{folder}/{name}", body)
        if self._told(name) is None:
            raise RuntimeError(f"backup {name} can't be verified")
        for old in [*kept, name][:-KEEP_BACKUPS]:
            self._fs.delete(self._path(f"{folder}/{old}"), False)
        return name

    def _told(self, name: str) -> dict | None:
        """What a snapshot says, if its own text is unchanged."""
        body = self.read_text(f"{self.root}/backups/{name}")
        return json.loads(body) if name.rsplit("-", 1)[1] == f"{hashlib.sha256(body.encode()).hexdigest()}.json" else None

    def _sound(self, name: str) -> bool:
        """Whether a snapshot and every byte it needs are unchanged."""
        told = self._told(name)
        return told is not None and self.fingerprint(told["manifest"]) == told["files"]

    def restore(self, name: str) -> None:
        """Publishes a snapshot's runs again; nothing that came later is deleted."""
        if not self._sound(name):
            raise RuntimeError(f"backup {name} can't be verified")
        told = self._told(name)["manifest"]
        now = self.manifest()
        self._publish(now | {"runs": told["runs"], "rolled_back": told["rolled_back"], "catalog": now.get("catalog", {}) | told.get("catalog", {})})

    def archive(self, originals: DataFrame) -> int:
        """Copies ``(path, content, file_sha256)`` to ``raw/<sha256>.<ext>``, by the executors; content that changed since it was hashed stops it."""
        folder = f"{self.root}/raw"
        self._fs.mkdirs(self._path(folder))
        ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        rows = originals.select("content", F.col("file_sha256").alias("sha"), F.concat("file_sha256", ext).alias("name"), F.sha2("content", 256).alias("now"))
        changed = rows.where("sha <> now")
        if not changed.isEmpty():
            raise PermissionError(f"{changed.count()} originals changed since they were read")

        def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs

            target, base = fs.FileSystem.from_uri(folder)
            for frame in frames:
                for name, content in zip(frame["name"], frame["content"]):
                    draft = f"{base}/_draft-{uuid.uuid4().hex}"
                    with target.open_output_stream(draft, compression=None) as out:
                        out.write(content)
                    target.move(draft, f"{base}/{name}")
                yield pd.DataFrame({"name": frame["name"]})

        return durable(rows.select("name", "content").mapInPandas(copy, "name string")).count()

    def originals(self) -> DataFrame:
        """``(name, sha, sound)`` of the archived files."""
        empty = self.spark.createDataFrame([], "name string, sha string, sound boolean")
        if not self.names(f"{self.root}/raw"):
            return empty
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "[0-9a-f]*").load(f"{self.root}/raw").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
        return files.withColumn("sha", F.split("name", r"\.")[0]).select("name", "sha", (F.sha2("content", 256) == F.col("sha")).alias("sound"))

    def status(self) -> dict[str, int]:
        return {name: (df.count() if (df := self.table(name)) is not None else 0) for name in TABLES}

    def doctor(self, archived: bool = False) -> list[str]:
        """What is wrong: rows without statement, links without rows, unknown amounts outside quarantine, repeated ids, a snapshot
        that does not verify, originals that changed and, with ``archived``, committed statements without their original."""
        rows, statements, links = self.transactions(), self.table("statements"), self.table("links")
        if rows is None:
            return []
        originals = self.originals()
        checks = {
            "rows without a statement": rows.join(statements, "statement_id", "left_anti"),
            "links without rows": links.join(rows.select(F.col("transaction_id").alias("from_id")), "from_id", "left_anti").select("from_id"),
            "amounts missing": rows.where("amount_minor IS NULL AND review_status <> 'cuarentena'"),
            "repeated transactions": rows.groupBy("transaction_id").count().where("count > 1"),
            "originals altered": originals.where("NOT sound"),
        }
        if archived:
            checks["originals missing"] = statements.join(originals.select(F.col("sha").alias("file_sha256")), "file_sha256", "left_anti")
        wrong = [name for name, df in checks.items() if not df.isEmpty()]
        kept = [n for n in self.names(f"{self.root}/backups") if n.startswith("backup-")]
        return wrong + (["last backup does not verify"] if kept and not self._sound(kept[-1]) else [])


def approve(staged: Staged, statement_id: str, reason: str) -> Staged:
    """The staged run with a reviewed statement made ready; hard blocks can't be approved."""
    if not reason.strip():
        raise ValueError("a reason is needed")
    row = staged.statements.where(F.col("statement_id") == statement_id).select("state", may_approve(F.col("blocks")).alias("ok"), "result").first()
    if row is None or row["state"] != "REVIEW_REQUIRED" or not row["ok"] or row["result"] == "BLOCKED":
        raise ValueError("this statement can't be approved")
    state = F.when(F.col("statement_id") == statement_id, "READY_TO_COMMIT").otherwise(F.col("state"))
    return Staged(staged.statements.withColumn("state", state), staged.rows, staged.links, staged.corrections)


def export(store: Store, accounts: DataFrame, institutions: DataFrame, folder: str) -> dict:
    """Writes movements and quarantine as sorted CSV parts of this version, reads them back, and publishes ``_contract.json`` last.

    Raises, and marks the export as failed, if what was written differs from the ledger.
    """
    version = store.manifest()["version"]
    rows = durable(ledger.export_rows(store.transactions(), accounts, institutions, store.table("links")))
    target = f"{folder.rstrip('/')}/v{version}"
    rows.orderBy("fecha", "transaction_id").write.mode("overwrite").option("header", True).csv(f"{target}/movimientos")
    back = store.spark.read.option("header", True).schema(rows.schema).csv(f"{target}/movimientos")
    want, got = ledger.export_totals(rows).first(), ledger.export_totals(back).first()
    if want != got:
        store.set_export_state("EXPORT_FAILED", f"{want} and {got}")
        raise RuntimeError(f"export differs from the ledger: {want} and {got}")
    held = store.quarantine()
    if held is None:
        held = store.spark.createDataFrame([], "statement_id string, account_id string, month string, reason string, n long, amount_minor long")
    held.orderBy("month", "account_id", "statement_id").write.mode("overwrite").option("header", True).csv(f"{target}/cuarentena")
    totals = ledger.contract_totals(held, store.transactions()).first().asDict()
    contract = {
        "schema_version": ledger.CONTRACT_VERSION, "columns": list(ledger.EXPORT_COLUMNS), "ledger_version": version, "n_rows": want["n"],
        "totals": {"income": str(want["income"]), "expense": str(want["expense"])}, "content_sha256": content_digest(back), **totals,
    }
    store.write_text(f"{folder.rstrip('/')}/_contract.json", json.dumps(contract, sort_keys=True))
    store.set_export_state("EXPORTED")
    return contract
