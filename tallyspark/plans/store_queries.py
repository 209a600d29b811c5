"""Named queries of the ledger store and of streams: ``txn`` is staged, committed and changed in a store of its own, and read back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import categorize, ledger, validate
from ..session import durable, shared_dir
from ..sources import statement_csv
from ..store import Store, approve, content_digest, stored_under
from ..streaming import late, ledger_stream, transfer_stream
from .. import staging
from .ingest import Staged
from .registry import query
from .views import TXN, declared, table, txn

_KEY = b"a key of the named queries"


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _store(spark: SparkSession) -> Store:
    return Store(spark, _folder(spark, "ledger"))


def _staged(spark: SparkSession, sf_dir: str, corrected: bool = False) -> Staged:
    """Statements of ``txn``: a third is for review, the others are ready; a corrected re-issue adds a unit to every thirteenth row."""
    k = F.col("transaction_id")
    base = txn(spark, sf_dir)
    minor = F.col("amount_minor") + (F.when(k % 13 == 0, 100).otherwise(0) if corrected else 0)
    again = "v2-" if corrected else "s"
    account = F.concat(F.lit("a"), F.col("account_id").cast("string"))
    start, end = F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 1, 31))
    rows = base.select(
        (k + (10_000_000 if corrected else 0)).cast("string").alias("transaction_id"), F.concat(F.lit(again), F.col("statement_id").cast("string")).alias("statement_id"), account.alias("account_id"), "date_op", minor.cast("long").alias("amount_minor"),
        F.lit("MXN").alias("currency"), F.concat("description", F.lit(" "), k.cast("string")).alias("description_norm"), F.concat("description", F.lit(" "), k.cast("string")).alias("description_raw"), "bank_ref",
        start.alias("period_start"), end.alias("period_end"), F.lit("ok").alias("review_status"), F.lit("gasto").alias("type"), F.lit(None).cast("string").alias("category"), F.lit("none").alias("category_source"), F.lit(None).cast("string").alias("dup_of"),
        F.lit("x 1.00").alias("raw_text"), F.array().cast("array<string>").alias("flags"),
    ).withColumn("fingerprint", ids.fingerprint(F.col("account_id"), F.col("date_op"), F.col("amount_minor"), F.col("description_norm"), F.col("bank_ref")))
    u = F.col("_u")
    s = base.select(F.col("statement_id").alias("_s"), F.col("account_id").alias("_u")).distinct().select(
        F.concat(F.lit(again), F.col("_s").cast("string")).alias("statement_id"), F.concat(F.lit("a"), u.cast("string")).alias("account_id"), F.when(u % 3 == 0, "REVIEW_REQUIRED").otherwise("READY_TO_COMMIT").alias("state"),
        F.when(u % 3 == 0, "WARNING").otherwise("OK").alias("result"), F.array().cast("array<string>").alias("blocks"), start.alias("period_start"), end.alias("period_end"), F.sha2(F.col("_s").cast("string"), 256).alias("file_sha256"),
    )
    links = spark.createDataFrame([], "from_id string, to_id string, amount_minor long")
    return Staged(durable(s), durable(rows), links)


_READY = "account_id % 3 <> 0"


@query(f"WITH {TXN} SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, amount_minor, 'ok' AS review_status FROM txn WHERE {_READY}")
def commit_visible(spark, sf_dir):
    """Ready statements are visible after a commit; a repeated commit and a second import of the same add nothing."""
    store, staged = _store(spark), _staged(spark, sf_dir)
    store.commit("r1", staged)
    store.commit("r1", staged)
    store.commit("r2", staged)
    return store.transactions().select("transaction_id", "amount_minor", "review_status")


@query(f"WITH {TXN} SELECT 's' || statement_id AS statement_id, 'a' || account_id AS account_id, strftime(date_op, '%Y-%m') AS month, 'REVIEW_REQUIRED' AS reason, count(*) AS n, CAST(sum(abs(amount_minor)) AS BIGINT) AS amount_minor FROM txn WHERE NOT {_READY} GROUP BY ALL")
def commit_quarantine(spark, sf_dir):
    store = _store(spark)
    store.commit("r1", _staged(spark, sf_dir))
    return store.quarantine().select("statement_id", "account_id", "month", F.regexp_extract("reason", "^[A-Z_]+", 0).alias("reason"), "n", "amount_minor")


@query(f"WITH {TXN}, one AS (SELECT min(statement_id) AS s FROM txn WHERE account_id = (SELECT min(account_id) FROM txn WHERE NOT {_READY})) SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, amount_minor FROM txn, one WHERE {_READY} OR statement_id = s")
def approve_commit(spark, sf_dir):
    """A held statement is approved and committed later: its rows come in and its quarantine record goes."""
    store, staged = _store(spark), _staged(spark, sf_dir)
    store.commit("r1", staged)
    first = txn(spark, sf_dir).where("account_id % 3 = 0").agg(F.min(F.struct("account_id", "statement_id")).alias("s")).first()["s"]["statement_id"]
    store.commit("r2", approve(staged, f"s{first}", "looked at"))
    held = store.quarantine().select("statement_id").distinct()
    return store.transactions().join(held, "statement_id", "left_anti").select("transaction_id", "amount_minor")


_FIXED = f"{TXN}, fix AS (SELECT * FROM txn WHERE {_READY} AND transaction_id % 13 = 0)"


@query(f"""WITH {_FIXED} SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CASE WHEN transaction_id % 13 = 0 THEN CAST(transaction_id + 10000000 AS VARCHAR) END AS dup_of, amount_minor FROM txn WHERE {_READY}
UNION ALL SELECT CAST(transaction_id + 10000000 AS VARCHAR), NULL, amount_minor + 100 FROM fix""")
def commit_supersede(spark, sf_dir):
    """A corrected re-issue whose unchanged rows are duplicates: only corrected rows come in, and supersede what they correct."""
    store = _store(spark)
    store.commit("r1", _staged(spark, sf_dir))
    store.commit("r2", _corrected(spark, sf_dir, store))
    return store.transactions().select("transaction_id", "dup_of", "amount_minor")


def _corrected(spark, sf_dir, store: Store) -> Staged:
    from ..operators import duplicates

    new = _staged(spark, sf_dir, corrected=True)
    dup = duplicates.find_duplicates(new.rows, store.transactions()).select("transaction_id", F.col("dup_of").alias("_d"))
    rows = durable(new.rows.join(dup, "transaction_id", "left").withColumn("dup_of", F.col("_d")).drop("_d"))
    return Staged(new.statements, rows, new.links)


@query(f"WITH {TXN} SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(NULL AS VARCHAR) AS dup_of, amount_minor FROM txn WHERE {_READY}")
def rollback_restore(spark, sf_dir):
    """Rolling the re-issue back restores what it superseded."""
    store = _store(spark)
    store.commit("r1", _staged(spark, sf_dir))
    store.commit("r2", _corrected(spark, sf_dir, store))
    store.rollback("r2")
    return store.transactions().select("transaction_id", "dup_of", "amount_minor")


@query("""SELECT 'a' || o_custkey AS account_id, strftime(o_orderdate, '%Y-%m') AS month, ['OK', 'WARNING', 'REVIEW_REQUIRED', 'BLOCKED'][CAST(max(1 + o_orderkey % 4) AS INT)] AS result FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2""")
def month_verdicts(spark, sf_dir):
    k = F.col("o_orderkey")
    verdict = F.get(F.array(*map(F.lit, ledger.VERDICTS)), (k % 4).cast("int"))
    s = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("account_id"), F.when(k % 5 != 0, F.col("o_orderdate").cast("date")).alias("period_end"), verdict.alias("result"))
    return ledger.month_verdicts(s)


@query(f"""WITH {TXN} SELECT 'a' || account_id AS account_id, CASE WHEN {_READY} AND account_id > (SELECT min(account_id) FROM txn WHERE {_READY}) THEN 'closed' ELSE 'pending' END AS status FROM (SELECT DISTINCT account_id FROM txn)""")
def close_month(spark, sf_dir):
    """One committed row is put into quarantine by a re-issue that is ambiguous; its account stays open, as those with held statements do."""
    store, staged = _store(spark), _staged(spark, sf_dir)
    least = txn(spark, sf_dir).where("account_id % 3 <> 0").agg(F.min("account_id")).first()[0]
    marked = staged.rows.withColumn("review_status", F.when(F.col("account_id") == f"a{least}", "cuarentena").otherwise(F.col("review_status")))
    store.commit("r1", Staged(staged.statements, marked, staged.links))
    closed, pending = store.close_month("c1", "2024-01")
    return spark.createDataFrame([(a, "closed") for a in closed] + [(a, "pending") for a in pending], "account_id string, status string")


@query(f"""WITH {TXN}, q AS (SELECT min(transaction_id) AS t FROM txn WHERE {_READY} AND transaction_id % 7 = 0)
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CASE WHEN transaction_id % 7 = 0 AND transaction_id <> t THEN 'cuarentena' ELSE 'ok' END AS review_status FROM txn, q WHERE {_READY}""")
def resolve_quarantine(spark, sf_dir):
    store, staged = _store(spark), _staged(spark, sf_dir)
    k = F.col("transaction_id").cast("long")
    store.commit("r1", Staged(staged.statements, staged.rows.withColumn("review_status", F.when(k % 7 == 0, "cuarentena").otherwise("ok")), staged.links))
    first = txn(spark, sf_dir).where("account_id % 3 <> 0 AND transaction_id % 7 = 0").agg(F.min("transaction_id")).first()[0]
    store.resolve("q1", str(first), "checked by hand")
    return store.transactions().select("transaction_id", "review_status")


@query(f"""WITH {TXN} SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, 'category' AS field, CAST(NULL AS VARCHAR) AS old_value, 'c' || transaction_id % 5 AS new_value FROM txn WHERE {_READY} AND transaction_id % 9 = 0""")
def corrections_persist(spark, sf_dir):
    """Corrections of rows that were committed are kept; those of held statements are not."""
    store, staged = _store(spark), _staged(spark, sf_dir)
    k = F.col("transaction_id")
    said = staged.rows.where(k.cast("long") % 9 == 0).select("transaction_id", F.lit("category").alias("field"), F.lit(None).cast("string").alias("old_value"), F.concat(F.lit("c"), (k.cast("long") % 5).cast("string")).alias("new_value"), F.lit("by hand").alias("reason"))
    store.commit("r1", Staged(staged.statements, categorize.apply_corrections(staged.rows, said.select("transaction_id", "field", "new_value"))[0], staged.links, said))
    return store.table("corrections").select("transaction_id", "field", "old_value", "new_value")


@query(f"""WITH {TXN} SELECT 'statements' AS name, count(DISTINCT statement_id) AS n FROM txn WHERE {_READY} UNION ALL SELECT 'transactions', count(*) FROM txn WHERE {_READY} UNION ALL SELECT 'links', 0
UNION ALL SELECT 'quarantine', count(DISTINCT (statement_id, strftime(date_op, '%Y-%m'))) FROM txn WHERE NOT {_READY} UNION ALL SELECT 'corrections', 0""")
def status_counts(spark, sf_dir):
    store = _store(spark)
    store.commit("r1", _staged(spark, sf_dir))
    found = store.status()
    return spark.createDataFrame([(n, found[n]) for n in ("statements", "transactions", "links", "quarantine", "corrections")], "name string, n long")


@query("SELECT unnest(['amounts missing', 'last backup does not verify', 'links without rows', 'repeated transactions', 'rows without a statement']) AS problem")
def doctor_checks(spark, sf_dir):
    """A ledger that was spoilt from outside in five ways."""
    store, staged = _store(spark), _staged(spark, sf_dir)
    store.commit("r1", staged)
    assert store.doctor() == []
    store.commit("r2", staged)
    some = durable(store.table("transactions", ["r1"]).orderBy("transaction_id").limit(3))
    spoilt = some.union(some).withColumn("amount_minor", F.lit(None).cast("long")).withColumn("statement_id", F.lit("gone"))
    spoilt = spoilt.drop("run_id").select("*", *stored_under(F.col("date_op"), F.col("account_id")))
    spoilt.write.mode("append").partitionBy("op_month", "bucket").parquet(f"{store.root}/transactions/run_id=r1")
    spark.createDataFrame([("nobody", "no one", 1)], "from_id string, to_id string, amount_minor long").write.mode("append").parquet(f"{store.root}/links/run_id=r1")
    return spark.createDataFrame([(p,) for p in store.doctor()], "problem string")


@query("SELECT true AS same, true AS other_key, true AS other_rows, true AS refused")
def seal_staging(spark, sf_dir):
    """The seal does not depend on the order of rows; another key or row changes it; a changed staging is not loaded."""
    store, staged = _store(spark), _staged(spark, sf_dir)
    shuffled = Staged(staged.statements.repartition(3), staged.rows.orderBy(F.desc("transaction_id")), staged.links)
    contents = store.contents(staged)
    sealed = store.sign(contents, _KEY)
    more = Staged(staged.statements, staged.rows.withColumn("amount_minor", F.when(F.col("transaction_id") == staged.rows.first()["transaction_id"], 1).otherwise(F.col("amount_minor") * 1)), staged.links)
    staging.save(store, "r1", staged, _KEY)
    staged.rows.limit(1).write.mode("append").parquet(f"{store.root}/staging/run_id=r1/rows")
    try:
        staging.load(store, "r1", _KEY)
        refused = False
    except PermissionError:
        refused = True
    return spark.createDataFrame([(store.seal(shuffled, _KEY) == sealed, store.sign(contents, b"another") != sealed, store.seal(more, _KEY) != sealed, refused)], "same boolean, other_key boolean, other_rows boolean, refused boolean")


@query(f"""WITH {TXN} SELECT transaction_id, statement_id, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY date_op, lpad(CAST(transaction_id AS VARCHAR), 9, '0')) AS k FROM txn) WHERE k <= 12""")
def staging_preview(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    rows = staged.rows.withColumn("transaction_id", F.lpad("transaction_id", 9, "0"))
    shown = ledger.first_rows(rows, "statement_id", ["date_op", "transaction_id"], 12)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("statement_id").orderBy("date_op", "transaction_id"))
    return shown.select(F.col("transaction_id").cast("long").alias("transaction_id"), F.substring("statement_id", 2, 99).cast("long").alias("statement_id"), place.cast("long").alias("place"))


@query(f"""WITH {TXN} SELECT account_id, strftime(date_op, '%Y-%m') AS month, count(*) AS n, CAST(sum(abs(amount_minor)) AS BIGINT) AS amount_minor FROM txn WHERE transaction_id % 4 = 0 OR transaction_id % 7 = 3 GROUP BY 1, 2""")
def quarantine_totals(spark, sf_dir):
    k = F.col("transaction_id")
    rows = txn(spark, sf_dir)
    held = rows.where(k % 4 == 0).select("account_id", F.date_format("date_op", "yyyy-MM").alias("month"), F.lit(1).alias("n"), F.abs("amount_minor").alias("amount_minor"))
    live = rows.where(k % 4 != 0).withColumn("review_status", F.when(k % 7 == 3, "cuarentena").otherwise("ok")).withColumn("dup_of", F.lit(None).cast("string"))
    return ledger.quarantine_totals(held, live)


@query(f"""WITH {TXN} SELECT count(*) FILTER (WHERE transaction_id % 4 = 0) AS quarantine_statements, CAST(sum(2) FILTER (WHERE transaction_id % 4 = 0) AS BIGINT) AS quarantine_txns, CAST(sum(abs(amount_minor)) FILTER (WHERE transaction_id % 4 = 0) AS BIGINT) AS quarantine_amount_minor,
  count(*) FILTER (WHERE transaction_id % 4 = 1) AS review_txns, CAST(sum(abs(amount_minor)) FILTER (WHERE transaction_id % 4 = 1) AS BIGINT) AS review_amount_minor FROM txn""")
def contract_totals(spark, sf_dir):
    k = F.col("transaction_id")
    rows = txn(spark, sf_dir).withColumn("review_status", F.when(k % 4 == 1, "cuarentena").otherwise("ok")).withColumn("dup_of", F.lit(None).cast("string"))
    return ledger.contract_totals(rows.where(k % 4 == 0).select(F.lit(2).alias("n"), F.abs("amount_minor").alias("amount_minor")), rows)


@query(f"""WITH {TXN} SELECT row_number() OVER (ORDER BY strftime(date_op, '%Y-%m'), account_id) AS place, strftime(date_op, '%Y-%m') AS month, account_id, count(*) AS n FROM txn GROUP BY 2, 3""")
def quarantine_order(spark, sf_dir):
    """The quarantine list by month and account, numbered by a range partitioning and the sizes of the ranges before."""
    held = txn(spark, sf_dir).groupBy(F.date_format("date_op", "yyyy-MM").alias("month"), "account_id").agg(F.count(F.lit(1)).alias("n"))
    ordered = durable(held.orderBy("month", "account_id").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = sizes.select("_part", "_first", F.aggregate(F.filter(F.lit(None).cast("array<bigint>"), lambda x: x > 0), F.lit(0).cast("long"), lambda a, b: a + b).alias("_x")).drop("_x")
    offsets, at = {}, 0
    for r in sorted(sizes.collect()):  # one row per partition
        offsets[r["_part"]] = at
        at += r["_size"]
    shift = F.create_map(*[F.lit(x) for p in offsets.items() for x in p]) if offsets else None
    numbered = ordered.join(before, "_part")
    place = (F.col("_at") - F.col("_first") + 1 + (shift[F.col("_part")] if shift is not None else F.lit(0))).cast("long")
    return numbered.select(place.alias("place"), "month", "account_id", "n")


@query("SELECT true AS tables, true AS digests_agree, true AS restored")
def backup_restore(spark, sf_dir):
    """A snapshot before a commit, restored: the tables have the same contents again."""
    store, staged = _store(spark), _staged(spark, sf_dir)
    store.commit("r1", staged)
    before = content_digest(store.transactions().drop("run_id"))
    name = store.backup("by hand")
    store.commit("r2", _corrected(spark, sf_dir, store))
    changed = content_digest(store.transactions().drop("run_id"))
    store.restore(name)
    return spark.createDataFrame([(changed != before, content_digest(store.transactions().drop("run_id")) == before, store.manifest()["runs"] == ["r1"])], "tables boolean, digests_agree boolean, restored boolean")


@query("SELECT 'stmt_' || lpad(lower(to_hex(o_orderkey)), 16, '0') AS statement_id, unnest(list_filter([CASE WHEN o_orderkey % 6 = 0 THEN 'inactive_account' END, CASE WHEN o_orderkey % 10 = 0 THEN 'currency_mismatch' END, CASE WHEN o_orderkey % 14 = 0 THEN 'inverted period' END, "
       "CASE WHEN o_orderkey % 22 = 0 THEN 'transaction_id does not follow from its fields' END, CASE WHEN o_orderkey % 26 = 0 THEN 'category not in the catalogue' END, CASE WHEN o_orderkey % 34 = 0 THEN 'reconciliation differs from the preview' END], lambda x: x IS NOT NULL)) AS problem FROM orders")
def revalidate_commit(spark, sf_dir):
    """One movement per statement; the statements were changed after their preview in six ways."""
    k = F.col("o_orderkey")
    c = F.col
    sid = F.concat(F.lit("stmt_"), F.lower(F.lpad(F.hex("o_orderkey"), 16, "0")))
    day = c("o_orderdate").cast("date")
    cents = F.round(c("o_totalprice").cast("decimal(18,2)") * 100).cast("long")
    o = table(spark, sf_dir, "orders").select("o_orderkey", sid.alias("statement_id"), F.when(k % 6 == 0, "old").otherwise("new").alias("account_id"), F.when(k % 10 == 0, "USD").otherwise("MXN").alias("currency"), F.when(k % 14 == 0, F.date_add(day, 3)).otherwise(day).alias("period_start"),
        day.alias("period_end"), cents.alias("cents"))
    s = o.select("statement_id", "account_id", "currency", "period_start", "period_end", F.lit(0).cast("long").alias("opening_minor"), c("cents").alias("closing_minor"), F.lit(1).cast("long").alias("declared_count"), F.lit(None).cast("long").alias("declared_credits"),
        F.lit(None).cast("long").alias("declared_debits"), F.lit(0).cast("long").alias("tolerance_minor"), F.lit("OK").alias("result"), F.lit(0).cast("long").alias("diff_minor"), (c("cents") + F.when(k % 34 == 0, 1).otherwise(0)).alias("credits_minor"),
        F.lit(0).cast("long").alias("debits_minor"), F.lit(1).cast("long").alias("n_transactions"))
    r = o.select("o_orderkey", "statement_id", "account_id", "currency", c("period_end").alias("date_op"), c("cents").alias("amount_minor"), F.lit("x").alias("description_raw"), F.lit(None).cast("string").alias("bank_ref"), F.lit("row:1").alias("locator"), F.lit(1).alias("sign"),
        F.lit("ingreso").alias("type"), F.when(k % 26 == 0, "typo").otherwise("Casa").alias("category"), F.lit("rule").alias("category_source"), F.lit("ok").alias("review_status"), F.lit("fp_1").alias("fingerprint"))
    own = ids.transaction_id(c("account_id"), c("statement_id"), c("date_op"), c("amount_minor"), c("description_raw"), c("bank_ref"), c("locator"))
    r = r.withColumn("transaction_id", F.when(k % 22 == 0, F.lit("txn_0123456789abcdef")).otherwise(own)).drop("o_orderkey")
    accounts = spark.createDataFrame([("old", False, "MXN"), ("new", True, "MXN")], "account_id string, active boolean, currency string")
    return validate.commit_problems(s, r, accounts, ("Casa",))


# --- sources --------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey % 4 AS file, strftime(o_orderdate, '%Y-%m-%d') AS date_op, 'order ' || o_orderkey AS description, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  'row:' || row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS locator FROM orders""")
def csv_data_source(spark, sf_dir):
    """Orders written as four statement files, which tasks of the data source read by ranges of 64 KB."""
    folder = _folder(spark, "statements")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit('"order '), F.col("o_orderkey").cast("string"), F.lit('"')), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("file"), "o_orderkey", line.alias("value"))
    heads = spark.createDataFrame([(k, n, t) for k in range(4) for n, t in ((-2, f"# account_id: a{k}"), (-1, "Fecha,Concepto,Importe"))], "file long, o_orderkey long, value string")
    for k in range(4):
        lines = heads.where(F.col("file") == k).unionByName(orders.where(F.col("file") == k))
        lines.repartitionByRange(1, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(f"{folder}/{k}")
    statement_csv.register(spark)
    for k in range(4):
        name = next(n for n in Store(spark, folder).names(f"{folder}/{k}") if n.startswith("part-"))
        source = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}/{name}")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}.csv")
        source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target)
    records = spark.read.format("statement_csv").option("rangeBytes", 1 << 16).load(folder)
    file = F.regexp_extract("path", r"([0-9])\.csv$", 1).cast("long").alias("file")
    return statement_csv.statement_rows(records).select(file, "date_op", "description", "amount", "locator")


# --- streams --------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` as a stream of the files of ``events``."""
    schema = table(spark, sf_dir, "events").schema
    e = ledger_stream.read_events(spark, sf_dir, schema, "events.parquet")
    cents = (F.round(F.col("value").cast("decimal(18,2)") * 100)).cast("long")
    return e.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account_id"), F.col("ts").cast("date").alias("date_op"), (F.when(F.col("event_type").isin("purchase", "error"), -1).otherwise(1) * cents).alias("amount_minor"))


def _run(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result: each micro-batch writes its own folder, so that a repeated one replaces it."""
    out = _folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query(f"WITH {TXN} SELECT transaction_id, account_id, date_op, amount_minor FROM txn")
def stream_deduplicated(spark, sf_dir):
    """The stream and its copy, each movement once."""
    rows = _stream(spark, sf_dir)
    return _run(spark, ledger_stream.deduplicated(rows.union(rows)).drop("op_ts")).drop("_batch")


@query(f"""WITH {TXN}, w AS (SELECT account_id, amount_minor, date_op - CAST(i AS INT) AS first_day FROM txn, range(0, 7) r(i))
SELECT account_id, first_day, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM w GROUP BY 1, 2""")
def stream_sliding_windows(spark, sf_dir):
    """Seven days sliding by one; of updated windows the last state counts."""
    found = _run(spark, ledger_stream.windowed(_stream(spark, sf_dir), "7 days", "1 day"), "update")
    rows = found.select("account_id", F.col("w.start").cast("date").alias("first_day"), "n", "total_minor", "_batch")
    return ledger.latest_by(rows, ["account_id", "first_day"], ["_batch"]).select("account_id", "first_day", "n", "total_minor")


@query(f"WITH {TXN} SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, amount_minor FROM txn")
def stream_commit(spark, sf_dir):
    """Every micro-batch is committed as a run named after it; the stream is started twice."""
    store = _store(spark)
    start = F.lit(dt.date(2024, 1, 1))

    def commit(batch: DataFrame, number: int) -> None:
        rows = batch.select(
            F.col("transaction_id").cast("string").alias("transaction_id"), F.concat(F.lit(f"b{number}-"), F.col("account_id").cast("string")).alias("statement_id"), F.col("account_id").cast("string").alias("account_id"), "date_op", "amount_minor", F.lit("MXN").alias("currency"),
            F.col("transaction_id").cast("string").alias("description_norm"), F.lit("").alias("bank_ref"), F.concat(F.lit("fp_"), F.col("transaction_id").cast("string")).alias("fingerprint"), start.alias("period_start"), start.alias("period_end"), F.lit("ok").alias("review_status"), F.lit(None).cast("string").alias("dup_of"),
        )
        s = rows.select("statement_id", "account_id", F.lit("READY_TO_COMMIT").alias("state"), F.lit("OK").alias("result"), "period_start", "period_end").distinct()
        store.commit(f"batch-{number}", Staged(s, rows, spark.createDataFrame([], "from_id string, to_id string, amount_minor long")))

    checkpoint = _folder(spark, "stream")
    for _ in range(2):
        ledger_stream.commit_stream(_stream(spark, sf_dir), commit, checkpoint).awaitTermination()
    return store.transactions().select("transaction_id", "amount_minor")


_LINK_SQL = f"""WITH {TXN}, s AS (SELECT d.transaction_id AS from_id, c.transaction_id AS to_id, c.amount_minor FROM txn d JOIN txn c ON d.amount_minor = -c.amount_minor
  WHERE d.amount_minor < 0 AND d.account_id <> c.account_id AND abs(d.date_op - c.date_op) <= 3 AND right(d.bank_ref, 1) = right(c.bank_ref, 1))
SELECT CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, amount_minor, 'bank_ref' AS signal FROM (SELECT *, count(*) OVER (PARTITION BY from_id) AS df, count(*) OVER (PARTITION BY to_id) AS dt FROM s) WHERE df = 1 AND dt = 1"""


@query(_LINK_SQL)
def stream_transfer_links(spark, sf_dir):
    """Movements arrive in two parts, the stream is stopped between; a heartbeat behind the last day closes all windows."""
    k = F.col("transaction_id")
    rows = txn(spark, sf_dir).select(k, "account_id", "date_op", "amount_minor", F.concat(F.lit("REF"), F.expr("right(bank_ref, 1)")).alias("bank_ref"), F.lit("").alias("description_norm"))
    # a debit and a credit of one account, which are no pair: either side of the join has a watermark of its own
    beat = rows.agg(F.date_add(F.max("date_op"), 100).alias("date_op")).select(F.explode(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))).alias("transaction_id"), F.lit(-1).cast("long").alias("account_id"), "date_op")
    beat = beat.select("*", (F.col("transaction_id") * 2 + 3).alias("amount_minor"), F.lit("").alias("bank_ref"), F.lit("").alias("description_norm"))
    into, out = _folder(spark, "arrivals"), _folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    for part in (rows.where(F.dayofmonth("date_op") <= 12), rows.where(F.dayofmonth("date_op") > 12), beat):
        part.write.mode("append").parquet(into)
        stream = spark.readStream.schema(rows.schema).parquet(into)
        transfer_stream.transfer_links(stream).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("from_id", "to_id", "amount_minor", "signal")


@query(f"""WITH {TXN}, a AS (SELECT transaction_id, date_trunc('second', ts) AS ts, transaction_id % 3 AS part FROM txn),
m AS (SELECT part, max(latest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM (SELECT part, max(ts) AS latest FROM a GROUP BY part))
SELECT transaction_id, coalesce(ts < mark - INTERVAL 10 DAY, false) AS late, CASE WHEN ts < mark - INTERVAL 10 DAY THEN date_diff('second', ts, mark - INTERVAL 10 DAY) END AS delay_seconds FROM a JOIN m USING (part)""")
def stream_late_quarantine(spark, sf_dir):
    """Movements arrive in three parts that all reach over the whole time; what is ten days behind is kept apart."""
    rows = txn(spark, sf_dir).select("transaction_id", "amount_minor", F.date_trunc("second", "ts").alias("op_ts"))
    into, out = _folder(spark, "arrivals"), _folder(spark, "stream")
    split = late.LateSplit(spark, out, dt.timedelta(days=10))
    for k in range(3):
        rows.where(F.col("transaction_id") % 3 == k).write.mode("append").parquet(into)
        late.split_late(spark.readStream.schema(rows.schema).parquet(into), out, dt.timedelta(days=10), f"{out}/checkpoint").awaitTermination()
    whole = split.on_time().select("transaction_id", F.lit(False).alias("late"), F.lit(None).cast("long").alias("delay_seconds"))
    return whole.unionByName(split.quarantined().select("transaction_id", F.lit(True).alias("late"), F.col("delay_seconds").cast("long").alias("delay_seconds")))
