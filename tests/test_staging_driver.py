from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallyspark import staging
from tallyspark.plans.ingest import Staged
from tallyspark.store import Store


def made(spark, n):
    """A run of ``n`` statements with one movement each; every third waits for a review, one has no state."""
    k = F.col("id")
    sid, account = F.concat(F.lit("s"), k.cast("string")).alias("statement_id"), F.lit("a").alias("account_id")
    state = F.when(k == 1, F.lit(None)).when(k % 3 == 0, "REVIEW_REQUIRED").otherwise("READY_TO_COMMIT").alias("state")
    rows = spark.range(n).select(k.cast("string").alias("transaction_id"), sid, account, F.lit(None).cast("date").alias("date_op"), k.alias("amount_minor"))
    return Staged(spark.range(n).select(sid, account, state), rows, rows.select(F.col("transaction_id").alias("from_id")).limit(0))


def test_a_run_of_many_statements_does_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    store, most = Store(spark, f"file://{tmp_path}/ledger"), []
    whole = DataFrame.collect

    def collect(self):
        found = whole(self)
        most.append(len(found))
        return found

    monkeypatch.setattr(DataFrame, "collect", collect)
    for run, n in (("few", 4), ("many", 3000)):
        told = staging.save(store, run, made(spark, n), b"k")
        assert told == staging.read_manifest(store, run) and staging.load(store, run, b"k").statements.count() == n
    few, many = (len(store.read_text(f"{store.root}/staging/run_id={run}/manifest.json")) for run in ("few", "many"))
    assert many < few + 50 and max(most) <= 3
    assert told["state_counts"] == {"READY_TO_COMMIT": 1999, "REVIEW_REQUIRED": 1000, "none": 1}
    assert staging.states(store, "many") == {f"s{k}": None if k == 1 else "REVIEW_REQUIRED" if k % 3 == 0 else "READY_TO_COMMIT" for k in range(3000)}
