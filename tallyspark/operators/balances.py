"""Signs of unsigned movements from the balances printed beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Movements whose signs are tried in all combinations, at most.
MAX_SEGMENT = 12


def signs_from_balance(rows: DataFrame, key: str, order: list[str], magnitude: str = "magnitude_minor", balance: str = "balance_minor", opening: str = "opening_minor") -> DataFrame:
    """Adds ``amount_minor``, signed by the change of balance, and ``doubtful``.

    The balance before a row is the last one printed, else the opening.  A row is
    doubtful without a balance before it or if its magnitude is not the change;
    the magnitude is kept, so reconciliation still tests something.
    """
    before = F.last(balance, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_delta", F.col(balance) - F.coalesce(before, F.col(opening)))
    out = out.withColumn("amount_minor", F.when(F.col("_delta") < 0, -F.abs(magnitude)).otherwise(F.abs(magnitude)))
    doubtful = F.col("_delta").isNull() | (F.abs("_delta") != F.abs(magnitude))
    return out.withColumn("doubtful", doubtful).drop("_delta")


def with_segments(rows: DataFrame, key: str, order: list[str], balance: str = "balance_minor", opening: str = "opening_minor", closing: str | None = None) -> DataFrame:
    """Adds ``segment`` and its ``net_minor``: rows up to the next printed balance, the last ones up to the closing."""
    w = Window.partitionBy(key).orderBy(*order)
    seg = F.count(balance).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("segment", seg)
    before = F.last(balance, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = Window.partitionBy(key, "segment")
    out = out.withColumn("_before", F.coalesce(before, F.col(opening)))
    end = F.max(balance).over(part)
    return out.withColumn("net_minor", F.coalesce(end, F.col(closing)) - F.col("_before") if closing else end - F.col("_before")).drop("_before")


def solve_segments(rows: DataFrame, key: str, order: str, magnitude: str = "magnitude_minor", guess: str | None = None) -> DataFrame:
    """``(key, segment, order, magnitude, sign)``: signs that sum up to the segment's net, 0 where they are not certain.

    All of one sign if that fits; else the guesses (a column of -1, 0, 1) if they
    fit; else the only combination that does, for up to ``MAX_SEGMENT`` rows.  A
    segment is a run of lines between two printed balances, so its list is short.
    """
    line = F.struct(F.col(order).alias("at"), F.abs(magnitude).alias("m"), (F.col(guess) if guess else F.lit(0)).cast("int").alias("g"))
    seg = rows.groupBy(key, "segment").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("net_minor").alias("net"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["m"])
    guessed = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["m"] * x["g"])
    sure = ~F.exists("lines", lambda x: x["g"] == 0)
    seg = seg.withColumn("n", F.size("lines")).withColumn("total", total).withColumn("guessed", F.when(sure, guessed))
    trial = F.expr(f"""
        CASE WHEN n <= {MAX_SEGMENT} AND net IS NOT NULL AND abs(net) < total THEN
          filter(sequence(0, cast(pow(2, n) - 1 AS int)), mask -> aggregate(sequence(0, n - 1), 0L, (a, k) -> a + lines[k].m * (1 - 2 * (shiftright(mask, k) & 1))) = net)
        END""")
    seg = seg.withColumn("fits", F.when(F.coalesce(F.col("guessed") == F.col("net"), F.lit(False)), F.lit(None)).otherwise(trial))
    sign = F.expr("""
        transform(lines, (x, k) -> CASE
          WHEN net = total THEN 1 WHEN net = -total THEN -1
          WHEN guessed = net THEN x.g
          WHEN size(fits) = 1 THEN 1 - 2 * (shiftright(fits[0], k) & 1)
          ELSE 0 END)""")
    seg = seg.withColumn("signs", sign)
    return seg.select(key, "segment", F.posexplode("lines").alias("_k", "x"), "signs").select(key, "segment", F.col("x.at").alias(order), F.col("x.m").alias(magnitude), F.expr("signs[_k]").alias("sign"))
