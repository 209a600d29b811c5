from pyspark.sql import functions as F

from tallyspark.operators import transfers
from tallyspark.streaming import ledger_stream as S


def source(spark, folder):
    rows = [(f"t{k}", f"a{k % 3}", f"2026-01-{1 + k % 25:02d}", (-1) ** k * 100 * (1 + k % 5)) for k in range(80)]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, d string, amount_minor long").withColumn("date_op", F.col("d").cast("date")).drop("d")
    df.repartition(4).write.parquet(f"{folder}/in")
    df.limit(20).write.mode("append").parquet(f"{folder}/in")
    return df


def test_stream_equals_batch(spark, tmp_path):
    df = source(spark, tmp_path)
    seen = []
    stream = S.deduplicated(S.read_events(spark, f"{tmp_path}/in", df.schema))
    q = S.commit_stream(stream, lambda batch, k: seen.extend((r["transaction_id"], r["amount_minor"]) for r in batch.collect()), f"{tmp_path}/ck1")
    q.awaitTermination()
    assert sorted(seen) == sorted((r["transaction_id"], r["amount_minor"]) for r in df.collect())
    again = S.commit_stream(stream, lambda batch, k: seen.extend(batch.collect()), f"{tmp_path}/ck1")
    again.awaitTermination()
    assert len(seen) == df.count()


def test_windows_and_transfers(spark, tmp_path):
    df = source(spark, tmp_path).dropDuplicates()
    df.coalesce(1).write.parquet(f"{tmp_path}/once")

    def run(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    once = S.read_events(spark, f"{tmp_path}/once", df.schema)
    by_week = run(S.windowed(once), "weeks", "complete")
    assert by_week.agg(F.sum("n")).first()[0] == df.count() and by_week.agg(F.sum("total_minor")).first()[0] == df.agg(F.sum("amount_minor")).first()[0]
    pairs = {tuple(r) for r in run(S.transfer_candidates(once), "pairs", "append").collect()}
    batch = {tuple(r) for r in transfers.transfer_pairs(df).select("from_id", "to_id", "amount_minor").collect()}
    assert pairs == batch and pairs
    assert run(S.sessions(once), "sessions", "complete").agg(F.sum("n")).first()[0] == df.count()
