"""Which account, and which bank, a document belongs to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_spaces, fold
from ..session import computed

# Names by which issuers print themselves, in order of preference among equals.
BANK_MARKERS = {
    "bbva": ("bbva", "bancomer"),
    "nu": ("nu ", "nubank", "cuenta nu", "nu méxico", "nu mexico"),
    "uala": ("uala", "ualá"),
    "gbm": ("gbm", "grupo bursátil", "grupo bursatil"),
    "vexi": ("vexi",),
    "hsbc": ("hsbc",),
}

#: Words of hints that are broadcast, at most.
BROADCAST_WORDS = 100_000


def occurrences(text: Column, part: str) -> Column:
    """How often a literal is found, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def detect_bank(text: Column, markers: Mapping[str, Sequence[str]] = BANK_MARKERS, hint: Column | None = None) -> Column:
    """The bank whose markers are found most often, the first among equals; without any, the one the hint begins with."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = [F.struct(sum((occurrences(low, m) for m in found), F.lit(0)).alias("n"), F.lit(-k).alias("turn"), F.lit(bank).alias("bank")) for k, (bank, found) in enumerate(markers.items())]
    best = F.array_max(F.array(*scores))
    by_hint = F.coalesce(*[F.when(F.lower(hint).startswith(bank), F.lit(bank)) for bank in markers]) if hint is not None else F.lit(None).cast("string")
    return F.when(best["n"] > 0, best["bank"]).otherwise(by_hint)


def account_scores(docs: DataFrame, hints: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, account_id, score)``: whole-word hits of an account's hints, without overlap, times the words of each hint.

    ``hints`` is ``(account_id, hint)``; accents and case do not count, repeated
    hints count once, and hints of one letter are ignored.  Words of texts are
    joined with words of hints by equality; a hint is found where all its words
    line up.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(fold(c), r"(?U)\W+", " ")), " ")
    folded = hints.select("account_id", collapse_spaces(fold(F.col("hint"))).alias("hint")).where("length(hint) >= 2").distinct()
    probes = folded.select("account_id", words(F.col("hint")).alias("_w"), F.size(F.split("hint", r"(?U)\s+")).alias("_weight")).where("_w[0] <> ''")
    parts = probes.select("account_id", F.array_join("_w", " ").alias("_run"), F.size("_w").alias("_n"), "_weight", F.posexplode("_w").alias("_k", "_word"))
    if parts.count() <= BROADCAST_WORDS:
        parts = F.broadcast(parts)
    split = computed(docs.select(key, words(F.coalesce(text, F.lit(""))).alias("_words")))
    hits = split.select(key, F.posexplode("_words").alias("_at", "_word")).join(parts, "_word")
    hint = [key, "account_id", "_run", "_n", "_weight"]
    whole = hits.groupBy(*hint, (F.col("_at") - F.col("_k")).alias("_at")).agg(F.count(F.lit(1)).alias("_c")).where("_c = _n")
    found = whole.groupBy(*hint).agg(F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col("_at")))).alias("_places"))
    # an occurrence of several words that begins inside the one counted before does not count
    apart = F.aggregate("_places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda got, at: F.when(at >= got["end"], F.struct((at + F.col("_n")).alias("end"), (got["n"] + 1).alias("n"))).otherwise(got))["n"]
    counted = found.select(key, "account_id", (F.when(F.col("_n") > 1, apart).otherwise(F.col("_c")) * F.col("_weight")).alias("_s"))
    return counted.groupBy(key, "account_id").agg(F.sum("_s").cast("long").alias("score"))


def identified(docs: DataFrame, hints: DataFrame, header: str = "header", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, account_id, method)`` of every document: the one its header names most often, else the one header and text do; null on a tie."""
    by_header = identify_accounts(account_scores(docs, hints, header, key), key).select(key, F.col("account_id").alias("_h"))
    whole = docs.select(key, F.concat_ws("\n", F.coalesce(header, F.lit("")), F.coalesce(text, F.lit(""))).alias("_all"))
    by_text = identify_accounts(account_scores(whole, hints, "_all", key), key).select(key, F.col("account_id").alias("_f"))
    out = docs.select(key).join(by_header, key, "left").join(by_text, key, "left")
    method = F.when(F.col("_h").isNotNull(), "match_hints:header").when(F.col("_f").isNotNull(), "match_hints:full").otherwise("ambiguous_or_none")
    return out.select(key, F.coalesce("_h", "_f").alias("account_id"), method.alias("method"))


def identify_accounts(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, account_id, margin)``: the best account, null on a tie; ``margin`` is its lead over the second."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "account_id")
    ranked = scores.where("score > 0").withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_k = 1")
    margin = F.col("score") - F.coalesce("_next", F.lit(0))
    return ranked.select(key, F.when(margin > 0, F.col("account_id")).alias("account_id"), margin.cast("long").alias("margin"))


def fragile(identified: DataFrame, least: int = 4) -> DataFrame:
    """Documents whose account leads by little."""
    return identified.where(F.col("margin") < least)
