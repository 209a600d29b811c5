"""Pairs of movements between a holder's own accounts.

A debit and a credit of one absolute amount and currency, in different accounts
and a few days apart, are a candidate; a further signal makes it a link, and only
if neither end has another signalled candidate.  Debits are joined with credits on
(amount, currency, stretch of days), so no pair is seen twice and nothing is crossed.  Amounts with
more movements than ``bucket_cap`` are for review, by rule, and never linked: they
are left out before that join, which bounds what one amount can give.

How many candidates a movement has is counted without pairs (``partner_classes``),
for any amount: partners within a few days are all of the other sign less those of
the own account, both running sums over days.  Where one is left, the same
difference of sums of days and of account numbers says which (``sole_pairs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions_holder, mentions_token
from ..session import durable, spread_join

# Words that identify no counterparty.
STOP_TOKENS = (
    "cuenta", "tarjeta", "credito", "crédito", "debito", "débito", "banco", "personal", "nomina", "nómina", "pago", "compra", "spei", "transferencia", "mexico", "méxico", "amex",
    "por", "saldo", "estado", "este", "esta", "generar", "comisiones", "cobradas", "abono", "cargo", "deposito", "depósito", "retiro", "movimiento", "movimientos", "fecha", "total",
    "importe", "monto", "referencia", "clave", "folio", "concepto", "de", "del", "la", "el", "los", "las", "un", "una", "al", "en", "con", "sin", "mi", "tu", "su", "lo", "se", "no", "es",
    "ya", "que", "para", "mx", "sa", "cv",
)
# Words of an own transfer, of a card payment, and of its receipt.
TRANSFER_WORDS = r"(?U)\b(spei|transferencia|traspaso|enviado|env[ií]o|recibido|dep[oó]sito|abono)\b"
CARD_PAYMENT = r"(?U)pago\s+(?:a\s+)?(?:tu\s+|mi\s+|la\s+)?tarjeta"
CARD_RECEIPT = r"(?U)\bpago\b|gracias"
REVIEW_FLAG = "posible_transferencia_sin_confirmar"
# How far each signal is trusted.
CONFIDENCE = {"bank_ref": 0.95, "counterparty_token": 0.8, "titular": 0.85, "pago_tarjeta": 0.85}


def refs_related(a: Column, b: Column) -> Column:
    """Equal references, or one that begins with the other if the shorter has six characters."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    related = (x == y) | ((F.least(F.length(x), F.length(y)) >= 6) & (x.startswith(y) | y.startswith(x)))
    return F.coalesce((x != "") & (y != "") & related, F.lit(False))


def within_bucket_cap(rows: DataFrame, cap: int, amount: str = "amount_minor") -> DataFrame:
    """Adds ``bucket_ok``: whether the row's absolute amount is not too common.

    Counted by a map-side combined aggregation and joined back; the rows of very
    common amounts meet their count where they are.
    """
    size = durable(rows.groupBy(F.abs(amount).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap).withColumn("_crowded", F.lit(True)))
    marked = spread_join(rows.withColumn("_bucket", F.abs(amount)), size, "_bucket", "_n", "left")
    return marked.withColumn("bucket_ok", F.col("_crowded").isNull()).drop("_bucket", "_crowded")


def _currency(rows: DataFrame) -> Column:
    return F.coalesce("currency", F.lit("MXN")).alias("currency") if "currency" in rows.columns else F.lit("MXN").alias("currency")


def partner_classes(rows: DataFrame, window_days: int = 3) -> DataFrame:
    """Movements with equal ``(amount_minor, currency, account_id, date_op, is_new)`` and how many partners each of them has.

    Columns: those five, ``movements``, ``first_id`` (their smallest id), ``partners``,
    and where that is 1 ``partner_account``, a hash, and ``partner_date``.  Partners
    have the opposite amount in another account at most ``window_days`` away, and
    one of the two is new (all are, without ``is_new``).  Every amount is counted,
    however common: a day of an account is one row, so no window holds more rows than
    there are days.  Movements without amount, account or day have no partners and
    are left out.
    """
    new = F.coalesce("is_new", F.lit(False)) if "is_new" in rows.columns else F.lit(True)
    whole = rows.where("amount_minor <> 0 AND account_id IS NOT NULL AND date_op IS NOT NULL")
    classes = durable(
        whole.groupBy("amount_minor", _currency(rows), "account_id", "date_op", new.alias("is_new")).agg(F.count(F.lit(1)).alias("movements"), F.min("transaction_id").alias("first_id"))
        .withColumn("_size", F.abs("amount_minor")).withColumn("_day", F.unix_date("date_op"))
    )
    who = F.xxhash64("account_id").cast("decimal(20,0)")
    sums = []
    for side, sign in (("debit", -1), ("credit", 1)):
        for kind, among in (("any", F.lit(True)), ("new", F.col("is_new"))):
            n = F.when((F.signum("amount_minor") == sign) & among, F.col("movements")).otherwise(0)
            sums += [F.sum(n).alias(f"{side}_{kind}"), F.sum(n * F.col("_day")).alias(f"{side}_{kind}_day"), F.sum(n.cast("decimal(18,0)") * who).alias(f"{side}_{kind}_who")]
    names = [f"{side}_{kind}{x}" for side in ("debit", "credit") for kind in ("any", "new") for x in ("", "_day", "_who")]
    key = ["_size", "currency"]
    by_account = classes.groupBy(*key, "account_id", "_day").agg(*sums)
    by_day = by_account.groupBy(*key, "_day").agg(*[F.sum(c).alias(c) for c in names])
    near = lambda df, *by: df.select(*key, *by, *[F.sum(c).over(Window.partitionBy(*key, *[b for b in by if b != "_day"]).orderBy("_day").rangeBetween(-window_days, window_days)).alias(c) for c in names])
    everyone = near(by_day, "_day").select(*key, "_day", *[F.col(c).alias(f"all_{c}") for c in names])
    others = near(by_account, "account_id", "_day").join(everyone, [*key, "_day"])
    others = others.select(*key, "account_id", "_day", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names])
    met = classes.join(others, [*key, "account_id", "_day"])
    # an old movement only counts new partners
    told = lambda x: F.when(F.col("amount_minor") < 0, F.when(F.col("is_new"), F.col(f"credit_any{x}")).otherwise(F.col(f"credit_new{x}"))).otherwise(F.when(F.col("is_new"), F.col(f"debit_any{x}")).otherwise(F.col(f"debit_new{x}")))
    one = told("") == 1
    return met.select(
        "amount_minor", "currency", "account_id", "date_op", "is_new", "movements", "first_id", told("").alias("partners"),
        F.when(one, told("_who").cast("long")).alias("partner_account"), F.when(one, F.date_from_unix_date(told("_day").cast("int"))).alias("partner_date"),
    )


def partner_counts(rows: DataFrame, window_days: int = 3) -> DataFrame:
    """``(transaction_id, class_id, partners)``, one row per movement: the smallest id of its class and with how many movements it is a pair.

    Movements that are in no class have no partners and are classes of their own.
    """
    keys = ["amount_minor", "_currency", "account_id", "date_op", "_new"]
    new = F.coalesce("is_new", F.lit(False)) if "is_new" in rows.columns else F.lit(True)
    classes = partner_classes(rows, window_days).withColumnsRenamed({"currency": "_currency", "is_new": "_new"}).select(*keys, "first_id", "partners")
    met = rows.withColumns({"_currency": _currency(rows), "_new": new}).join(classes, keys, "left")
    return met.select("transaction_id", F.coalesce("first_id", "transaction_id").alias("class_id"), F.coalesce("partners", F.lit(0)).cast("long").alias("partners"))


def sole_pairs(rows: DataFrame, window_days: int = 3) -> DataFrame:
    """``(from_id, to_id, amount_minor, currency)``: debits and credits that have each other as their only partner, of every amount.

    Both are alone in their class, so classes are joined, by the account and day
    of the one partner, and no other pair comes up.
    """
    alone = durable(partner_classes(rows, window_days).where("partners = 1 AND movements = 1"))
    debit = alone.where("amount_minor < 0").select((-F.col("amount_minor")).alias("amount_minor"), "currency", F.col("partner_account").alias("_who"), F.col("partner_date").alias("date_op"), F.col("first_id").alias("from_id"), F.col("account_id").alias("_from"), F.col("is_new").alias("_new"))
    credit = alone.where("amount_minor > 0").select("amount_minor", "currency", F.xxhash64("account_id").alias("_who"), "date_op", F.col("first_id").alias("to_id"), F.col("account_id").alias("_to"), F.col("is_new").alias("_new2"))
    met = debit.join(credit, ["amount_minor", "currency", "_who", "date_op"]).where("_from <> _to AND (_new OR _new2)")
    return met.select("from_id", "to_id", "amount_minor", "currency")


def transfer_pairs(rows: DataFrame, window_days: int = 3, carry: tuple[str, ...] = ("bank_ref", "description_norm", "account_type", "is_new")) -> DataFrame:
    """Debit-credit candidates: ``from_*`` and ``to_*`` of id, account, date and carried columns, ``amount_minor`` positive.

    Days are cut into stretches of the window's length; a debit meets the credits
    of its own stretch and of both neighbours, which holds all within the window.
    """
    have = [c for c in carry if c in rows.columns]
    side = lambda name: [F.col("transaction_id").alias(f"{name}_id"), F.col("account_id").alias(f"{name}_account"), F.col("date_op").alias(f"{name}_date"), *[F.col(c).alias(f"{name}_{c}") for c in have]]
    currency = _currency(rows)
    stretch = F.floor(F.datediff("date_op", F.lit("1970-01-01").cast("date")) / max(window_days, 1))
    debits = rows.where("amount_minor < 0").select((-F.col("amount_minor")).alias("amount_minor"), currency, stretch.alias("_days"), *side("from"))
    credits = rows.where("amount_minor > 0").select("amount_minor", currency, F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_days"), *side("to"))
    pairs = debits.join(credits, ["amount_minor", "currency", "_days"]).drop("_days").where((F.col("from_account") != F.col("to_account")) & (F.abs(F.datediff("from_date", "to_date")) <= window_days))
    return pairs.where("from_is_new OR to_is_new") if "is_new" in have else pairs


def capped_pairs(rows: DataFrame, window_days: int = 3, bucket_cap: int = 300) -> DataFrame:
    """``transfer_pairs`` of the amounts that are not too common."""
    return transfer_pairs(within_bucket_cap(rows, bucket_cap).where("bucket_ok").drop("bucket_ok"), window_days)


def account_tokens(accounts: DataFrame) -> DataFrame:
    """``(account_id, token)``: explicit tokens, and words of three letters in the names of account and institution."""
    words = F.split(F.lower(F.concat_ws(" ", "name", "institution")), r"(?U)\W+")
    named = accounts.select("account_id", F.explode(F.filter(words, lambda w: F.length(w) >= 3)).alias("token"))
    explicit = accounts.select("account_id", F.explode(F.transform("counterparty_tokens", F.lower)).alias("token")) if "counterparty_tokens" in accounts.columns else named.limit(0)
    return named.union(explicit).where(~F.col("token").isin(*STOP_TOKENS)).distinct()


def text_words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"(?U)\W+", " "), " "))


def token_mentions(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(id, account_id)``: which of ``(id, text, account_id)`` mention a token of their account as a whole word.

    Words are joined with the first words of the account's tokens, so a text meets
    the tokens it may have and no others, however many accounts there are.
    """
    word = F.explode(text_words(F.col("text"))).alias("_word")
    given = tokens.select("account_id", "token", F.split("token", " ")[0].alias("_word"))
    met = texts.where("text IS NOT NULL").select("id", "text", "account_id", word).join(given, ["account_id", "_word"])
    return met.where(mentions_token(F.col("text"), F.col("token"), STOP_TOKENS, 3, TRANSFER_WORDS)).select("id", "account_id").distinct()


def with_signal(pairs: DataFrame, tokens: DataFrame | None = None, holder: str | None = None) -> DataFrame:
    """Adds ``signal`` and ``confidence``, the first of: reference, counterparty token, holder's name, card payment.

    Tokens are looked up by ``token_mentions``.  A stream of movements is not paired at
    all, see ``streaming.transfer_stream``.
    """
    if tokens is None:
        token = F.lit(False)
    else:
        end = lambda name, other: pairs.select(F.col(f"{name}_id").alias("id"), F.col(f"{name}_description_norm").alias("text"), F.col(f"{other}_account").alias("account_id"))
        hits = durable(token_mentions(end("from", "to").union(end("to", "from")).distinct(), tokens))
        for name, other in (("from", "to"), ("to", "from")):
            pairs = pairs.join(hits.select(F.col("id").alias(f"{name}_id"), F.col("account_id").alias(f"{other}_account"), F.lit(True).alias(f"_{name}_said")), [f"{name}_id", f"{other}_account"], "left")
        token = F.coalesce("_from_said", "_to_said", F.lit(False))
    named = mentions_holder(F.col("to_description_norm"), holder) if holder else F.lit(False)
    if {"to_account_type", "from_description_norm", "to_description_norm"} <= set(pairs.columns):
        card = F.col("to_account_type").startswith("credito") & F.lower("from_description_norm").rlike(CARD_PAYMENT) & F.lower("to_description_norm").rlike(CARD_RECEIPT)
        to_card = F.coalesce(F.col("to_account_type").startswith("credito"), F.lit(False))
    else:
        card, to_card = F.lit(False), F.lit(False)
    signal = F.when(refs_related(F.col("from_bank_ref"), F.col("to_bank_ref")), "bank_ref").when(token, "counterparty_token").when(named, "titular").when(card, "pago_tarjeta")
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    out = pairs.withColumn("signal", signal).withColumn("confidence", confidence[F.col("signal")])
    return out.withColumn("kind", F.when(to_card, "card_payment").otherwise("transfer")).drop("_from_said", "_to_said")


def single_partner(pairs: DataFrame) -> DataFrame:
    """Pairs both of whose ends are in no other pair."""
    by = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return pairs.withColumn("_from", by("from_id")).withColumn("_to", by("to_id")).where("_from = 1 AND _to = 1").drop("_from", "_to")


def transfer_links(rows: DataFrame, tokens: DataFrame | None = None, holder: str | None = None, window_days: int = 3, bucket_cap: int = 300) -> DataFrame:
    """Links between own movements: signalled pairs whose ends have no other signalled pair."""
    return single_partner(with_signal(capped_pairs(rows, window_days, bucket_cap), tokens, holder).where("signal IS NOT NULL"))


def unsettled_ends(rows: DataFrame, tokens: DataFrame | None = None, holder: str | None = None, window_days: int = 3, bucket_cap: int = 300) -> DataFrame:
    """``(transaction_id)`` of new movements in pairs that are no links, for want of a signal or for ambiguity; amounts that are too common have no pairs."""
    pairs = with_signal(capped_pairs(rows, window_days, bucket_cap), tokens, holder)
    linked = single_partner(pairs.where("signal IS NOT NULL")).select("from_id", "to_id")
    loose = pairs.join(linked, ["from_id", "to_id"], "left_anti")
    new = lambda side: loose.where(f"{side}_is_new" if "is_new" in rows.columns else "true").select(F.col(f"{side}_id").alias("transaction_id"))
    return new("from").union(new("to")).distinct()


def transfer_reviews(rows: DataFrame, tokens: DataFrame | None = None, holder: str | None = None, window_days: int = 3, bucket_cap: int = 300) -> DataFrame:
    """``(transaction_id)`` of new movements to look at: too common amounts, pairs without a signal, ambiguous ones."""
    crowded = within_bucket_cap(rows, bucket_cap).where("NOT bucket_ok").where("is_new" if "is_new" in rows.columns else "true").select("transaction_id")
    return crowded.union(unsettled_ends(rows, tokens, holder, window_days, bucket_cap)).distinct()


def recent_pool(committed: DataFrame, statements: DataFrame, days: int = 7) -> DataFrame:
    """Committed rows that movements of new statements may pair with: from ``days`` before the first period to ``days`` after the last.

    An unknown bound does not limit; superseded and quarantined rows are left out.
    """
    span = statements.agg(
        F.when(F.count_if(F.col("period_start").isNull()) == 0, F.date_sub(F.min("period_start"), days)).alias("low"), F.when(F.count_if(F.col("period_end").isNull()) == 0, F.date_add(F.max("period_end"), days)).alias("high")
    ).first()
    pool = committed.where("dup_of IS NULL AND review_status <> 'cuarentena'")
    for bound, keep in ((span["low"], lambda d: F.col("date_op") >= d), (span["high"], lambda d: F.col("date_op") <= d)):
        pool = pool.where(keep(F.lit(bound))) if bound is not None else pool
    return pool


def revalidate_links(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Links whose ends exist, differ in account, have opposite amounts of one currency, and one of which is new."""
    end = lambda name: rows.select(F.col("transaction_id").alias(f"{name}_id"), F.col("account_id").alias(f"{name}_acc"), F.col("amount_minor").alias(f"{name}_minor"), F.col("currency").alias(f"{name}_ccy"), F.col("is_new").alias(f"{name}_new"))
    both = links.join(end("from"), "from_id").join(end("to"), "to_id")
    return both.where("from_minor < 0 AND to_minor = -from_minor AND from_acc <> to_acc AND from_ccy = to_ccy AND (from_new OR to_new)").select(*links.columns)
