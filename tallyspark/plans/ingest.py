"""From raw statements to staged ones.

Statements, rows and links are read by several later steps and by the commit, so
each is computed once into the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ids, money, text
from ..operators import categorize, duplicates, identify, reconcile, transfers, validate
from ..session import computed, durable


@dataclass
class Config:
    """What a holder configures: accounts, rules, policy."""

    accounts: DataFrame  # account_id, name, institution, currency, type, active, inverted[, counterparty_tokens]
    rules: Sequence[dict] = ()
    tolerance_by_account: dict = field(default_factory=dict)
    tolerance_by_currency: dict = field(default_factory=lambda: {"MXN": 0, "USD": 0})
    default_tolerance: int = 0
    row_cap: int = 5000
    bucket_cap: int = 300
    window_days: int = 3
    holder: str | None = None
    hints: DataFrame | None = None  # account_id, hint
    categories: Sequence[str] = ()


@dataclass
class Staged:
    statements: DataFrame
    rows: DataFrame
    links: DataFrame
    corrections: DataFrame | None = None  # transaction_id, field, old_value, new_value, reason


def canonical_rows(raw: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Statements and canonical rows of raw statements ``(path, file_sha256, method, meta, rows, warnings)``."""
    m = lambda key: F.col("meta")[key]
    accounts = config.accounts.select("account_id", F.col("currency").alias("account_currency"), F.col("type").alias("account_type"), F.col("active").alias("account_active"), "inverted")
    s = raw.withColumn("account_id", m("account_id")).join(accounts, "account_id", "left")
    s = s.withColumn("statement_id", ids.statement_id(F.col("account_id"), F.col("file_sha256"))).withColumn("currency", F.coalesce(F.upper(m("currency")), "account_currency", F.lit("MXN")))
    s = s.withColumn("period_start", dates.normalize_date(m("period_start"))).withColumn("period_end", dates.normalize_date(m("period_end")))
    for name, key in (("opening_minor", "opening_balance"), ("closing_minor", "closing_balance"), ("declared_credits", "declared_credits"), ("declared_debits", "declared_debits")):
        s = money.with_parsed_amount(s.withColumn("_raw", m(key)), "_raw", "currency", name).drop("_raw")
    s = computed(s)
    s = s.withColumn("declared_count", money.try_long(m("declared_count"))).withColumn("native", validate.native_source(F.col("method"))).withColumn("over_limit", F.size("rows") > config.row_cap)
    flip = F.col("native") & F.coalesce("inverted", F.lit(False))
    for name in ("opening_minor", "closing_minor"):
        s = s.withColumn(name, F.when(flip, -F.col(name)).otherwise(F.col(name)))
    for name in ("declared_credits", "declared_debits"):
        s = s.withColumn(name, F.when(~flip, F.col(name)))
    r = s.select("statement_id", "account_id", "account_type", "currency", "period_start", "period_end", "native", "inverted", F.explode(F.slice("rows", 1, config.row_cap)).alias("r")).select("*", "r.*").drop("r")
    r = money.with_parsed_amount(r, "amount", "currency", "amount_minor")
    r = computed(money.with_parsed_amount(r, "balance", "currency", "balance_after_minor"))
    c = F.col
    hint = F.year("period_end")
    r = r.withColumn("_raw_date", c("date_op")).withColumn("date_op", dates.resolve_year(dates.normalize_date(c("_raw_date"), hint), c("_raw_date"), c("period_start"), c("period_end")))
    r = r.withColumn("_raw_post", c("date_post")).withColumn("date_post", dates.normalize_date(c("date_post"), hint)).withColumn("date_value", dates.normalize_date(c("date_value"), hint))
    r = computed(r)
    r = r.withColumn("amount_minor", money.cash_flow(c("amount_minor"), c("native"), F.coalesce("inverted", F.lit(False))))
    r = r.withColumn("description_raw", F.coalesce("description", F.lit(""))).withColumn("description_norm", text.normalize_description(c("description")))
    r = text.composed(r, "description", "_composed")
    r = computed(r.withColumn("merchant_norm", text.normalize_merchant(c("_composed"))))
    r = r.withColumn("transaction_id", ids.transaction_id(c("account_id"), c("statement_id"), c("date_op"), c("amount_minor"), c("description_raw"), c("bank_ref"), c("locator")))
    sure = c("amount_minor").isNotNull() & c("date_op").isNotNull()
    r = r.withColumn("fingerprint", F.when(sure, ids.fingerprint(c("account_id"), c("date_op"), c("amount_minor"), c("description_norm"), c("bank_ref"))).otherwise(ids.doubtful_fingerprint(c("statement_id"), c("locator"))))
    r = r.withColumn("sign", money.sign_of(c("amount_minor"))).withColumn("type", money.basic_type(c("amount_minor"), c("description_norm")))
    outside = F.coalesce(dates.period_distance(c("date_op"), c("period_start"), c("period_end")) > 0, F.lit(False))
    flags = F.array_compact(F.array(
        F.when(c("date_op").isNull(), "fecha_dudosa"), F.when(c("amount_minor").isNull(), "importe_dudoso"), F.when((F.coalesce("_raw_post", F.lit("")) != "") & c("date_post").isNull(), "fecha_cargo_dudosa"),
        F.when(outside, "fecha_fuera_de_periodo"),
    ))
    r = r.withColumn("flags", flags).withColumn("errors", validate.row_errors())
    keep = ["transaction_id", "statement_id", "account_id", "account_type", "date_op", "date_post", "date_value", "description_raw", "description_norm", "merchant_norm", "amount_minor", "currency", "sign", "type", "balance_after_minor", "locator", "bank_ref", "fingerprint", "raw_text", "period_start", "period_end", "flags", "errors"]
    return computed(s.drop("rows")), computed(r.select(*keep))


def build(raw: DataFrame, config: Config, committed: DataFrame | None = None) -> Staged:
    """Validated, categorised, deduplicated, reconciled and linked statements; ``committed`` are the rows of the store."""
    statements, rows = map(durable, canonical_rows(raw, config))
    history = categorize.history_map(committed) if committed is not None else None
    rows = categorize.categorize(rows, config.rules, history)
    if committed is not None:
        dup = duplicates.find_duplicates(rows, committed.where("dup_of IS NULL"))
        rows = rows.join(dup.select("transaction_id", "dup_of", "suspicious"), "transaction_id", "left")
        rows = rows.withColumn("flags", F.when(F.col("suspicious"), F.array_append("flags", "posible_duplicado_sin_confirmar")).otherwise(F.col("flags"))).drop("suspicious")
    else:
        rows = rows.withColumn("dup_of", F.lit(None).cast("string"))
    rows = durable(rows)
    counts = rows.groupBy("statement_id").agg(F.count_if(F.array_contains("flags", "fecha_dudosa") | F.array_contains("flags", "importe_dudoso")).alias("n_doubtful"), F.count_if(F.size("errors") > 0).alias("n_invalid"))
    tol = reconcile.tolerance(F.col("account_id"), F.col("currency"), config.tolerance_by_account, config.tolerance_by_currency, config.default_tolerance)
    done = reconcile.reconcile(statements.withColumn("tolerance_minor", tol), rows).join(counts, "statement_id", "left").fillna(0, ["n_doubtful", "n_invalid"])
    done = validate.statement_blocks(done)
    done = done.withColumn("state", validate.decide_state(F.col("blocks"), F.col("result")))
    own = rows.where("dup_of IS NULL").withColumn("is_new", F.lit(True)).join(config.accounts.select("account_id"), "account_id", "left_semi")
    pool = own
    if committed is not None:
        live = transfers.recent_pool(committed, statements).withColumn("is_new", F.lit(False))
        pool = own.unionByName(live, allowMissingColumns=True)
    tokens = transfers.account_tokens(config.accounts)
    pool = durable(pool)
    links = transfers.transfer_links(pool, tokens, config.holder, config.window_days, config.bucket_cap)
    review = transfers.transfer_reviews(pool, tokens, config.holder, config.window_days, config.bucket_cap).withColumn("_r", F.lit(True))
    rows = rows.join(review, "transaction_id", "left").withColumn("flags", F.when(F.col("_r"), F.array_append("flags", transfers.REVIEW_FLAG)).otherwise(F.col("flags"))).drop("_r")
    return Staged(durable(done), durable(rows), durable(links))


#: Lines at the top of a document that name its issuer.
HEADER_LINES = 30


def with_accounts(docs: DataFrame, hints: DataFrame) -> DataFrame:
    """``docs`` with ``account_id``: the given one, else the one that the header, or header and text, names most often; null on a tie."""
    texts = docs.select("doc_id", "text", F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, HEADER_LINES), "\n").alias("header"))
    found = identify.identified(texts, hints).select("doc_id", F.col("account_id").alias("_account"))
    given = docs if "account_id" in docs.columns else docs.withColumn("account_id", F.lit(None).cast("string"))
    return given.join(found, "doc_id", "left").withColumn("account_id", F.coalesce("account_id", "_account")).drop("_account")


def from_documents(docs: DataFrame, movements: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Raw statements from parsed text documents: ``docs`` as the grammars take them, ``movements`` and ``warnings`` as they give them."""
    docs, movements = durable(docs), durable(movements)
    cents = lambda name: F.when(F.col(name).isNotNull(), F.format_string("%s%d.%02d", F.when(F.col(name) < 0, "-").otherwise(""), F.expr(f"abs({name}) div 100"), F.abs(name) % 100))
    row = F.struct(
        F.concat(F.lit("line:"), F.coalesce(F.col("line_no").cast("string"), F.lit("summary"))).alias("locator"), F.col("description").alias("raw_text"), F.coalesce(F.date_format("date_op", "yyyy-MM-dd"), "date_raw").alias("date_op"),
        F.date_format("date_post", "yyyy-MM-dd").alias("date_post"), F.lit(None).cast("string").alias("date_value"), "description", F.when(~F.col("doubtful"), cents("amount_minor")).alias("amount"), cents("balance_minor").alias("balance"), F.lit(None).cast("string").alias("bank_ref"),
    )
    rows = movements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", row.alias("r")))).alias("_rows")).select("doc_id", F.transform("_rows", lambda x: x["r"]).alias("rows"))
    meta = F.map_filter(F.create_map(
        F.lit("account_id"), F.col("account_id"), F.lit("period_start"), F.date_format("period_start", "yyyy-MM-dd"), F.lit("period_end"), F.date_format("period_end", "yyyy-MM-dd"),
        F.lit("opening_balance"), cents("opening_minor"), F.lit("closing_balance"), cents("closing_minor"), F.lit("declared_credits"), cents("declared_credits"), F.lit("declared_debits"), cents("declared_debits"), F.lit("declared_count"), F.col("declared_count").cast("string"),
    ), lambda k, v: v.isNotNull())
    joined = docs.join(rows, "doc_id", "left")
    none = F.array().cast("array<string>")
    if warnings is not None:
        said = warnings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", F.concat(F.lit("line "), F.col("line_no").cast("string")), "warning"))).alias("_said"))
        joined = joined.join(said, "doc_id", "left")
    kept = F.coalesce("_said", none) if warnings is not None else none
    return joined.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("file_sha256"), F.coalesce(F.concat(F.lit("pdf_template:"), "bank"), F.lit("pdf_text")).alias("method"), meta.alias("meta"), F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)).alias("rows"), kept.alias("warnings"))
