"""Categories by prioritised rules, then by verified history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACK = "Por revisar"


def java_regex(pattern: str) -> bool:
    """Whether the engine that runs the pattern accepts it."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(f"(?iU){pattern}")
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def rule_matches(rule: dict, rows_field: Column | None = None) -> Column:
    """``equals``, ``contains`` or ``regex`` on a field, ignoring case; an unknown operation never matches."""
    value = F.lower(F.coalesce(rows_field if rows_field is not None else F.col(rule.get("field", "merchant_norm")), F.lit("")))
    target, op = str(rule.get("value", "")), rule.get("op", "contains")
    if op == "equals":
        return value == target.lower()
    if op == "contains":
        return value.contains(target.lower())
    if op == "regex":
        return value.rlike(f"(?iU){target}") if java_regex(target) else F.lit(False)
    return F.lit(False)


def ordered(rules: Sequence[dict]) -> list[dict]:
    """Lowest priority number first, in the given order among equals."""
    return sorted(rules, key=lambda r: r.get("priority", 100))


def categorize(rows: DataFrame, rules: Sequence[dict], history: DataFrame | None = None) -> DataFrame:
    """Adds ``category``, ``category_source`` (rule, history, none) and ``review_status``; ``history`` is (merchant_norm, category)."""
    by_rule = F.coalesce(*[F.when(rule_matches(r), F.lit(r["category"])) for r in ordered(rules)], F.lit(None).cast("string"))
    out = rows.withColumn("_rule", by_rule)
    if history is not None:
        out = out.join(history.select("merchant_norm", F.col("category").alias("_past")).where("merchant_norm <> ''"), "merchant_norm", "left")
    else:
        out = out.withColumn("_past", F.lit(None).cast("string"))
    source = F.when(F.col("_rule").isNotNull(), "rule").when(F.col("_past").isNotNull(), "history").otherwise("none")
    out = out.withColumn("category", F.coalesce("_rule", "_past", F.lit(FALLBACK))).withColumn("category_source", source)
    return out.withColumn("review_status", F.when(F.col("category_source") == "none", "por_revisar").otherwise("ok")).drop("_rule", "_past")


def history_map(committed: DataFrame) -> DataFrame:
    """``(merchant_norm, category)``: the earliest verified category of each merchant."""
    known = committed.where("category_source IN ('manual', 'history', 'rule') AND category IS NOT NULL AND merchant_norm <> ''").where(F.col("category") != FALLBACK)
    return known.groupBy("merchant_norm").agg(F.min_by("category", F.struct("created_at", "transaction_id")).alias("category"))


def apply_corrections(rows: DataFrame, corrections: DataFrame, allowed: Sequence[str] = ("category", "review_status", "type")) -> tuple[DataFrame, DataFrame]:
    """Rows with corrections ``(transaction_id, field, new_value)`` applied, the last per field, and the rejected ones with a reason.

    A manual category makes the source ``manual``.
    """
    ids = rows.select("transaction_id", F.lit(True).alias("_known"))
    judged = corrections.join(ids, "transaction_id", "left").withColumn("reason", F.when(F.col("_known").isNull(), "unknown transaction").when(~F.col("field").isin(*allowed), "field not allowed")).drop("_known")
    good = judged.where("reason IS NULL")
    order = F.col("created_at") if "created_at" in corrections.columns else F.lit(0)
    latest = good.groupBy("transaction_id").agg(*[F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, order)).alias(f"_{f}") for f in allowed])
    out = rows.join(latest, "transaction_id", "left")
    for f in allowed:
        if f in rows.columns:
            out = out.withColumn(f, F.coalesce(f"_{f}", f))
    if "category_source" in rows.columns:
        out = out.withColumn("category_source", F.when(F.col("_category").isNotNull(), "manual").otherwise(F.col("category_source")))
    return out.drop(*[f"_{f}" for f in allowed]), judged.where("reason IS NOT NULL")
