import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.operators import transfers
from tallyspark.streaming import late, transfer_stream

SCHEMA = "transaction_id string, account_id string, date_op date, amount_minor long, currency string, bank_ref string, description_norm string, account_type string"
DAY0 = dt.date(2026, 1, 1)


def movements(seed, n):
    rng = random.Random(seed)
    pick = lambda k: (f"t{k:04d}", rng.choice("ABC"), DAY0 + dt.timedelta(days=rng.randrange(60)), rng.choice([-1, 1]) * 100 * rng.randrange(1, 25), rng.choice(["MXN", None, "USD"]), rng.choice(["REF00001", "REF00002", None]), rng.choice(["x", "spei a bancolor"]), "debito")
    return [pick(k) for k in range(n)]


def beat(days):
    """A debit and a credit that are no pair: either side of the join has a watermark of its own."""
    return [(f"beat{x}", "Z", DAY0 + dt.timedelta(days=days), x, None, None, "", None) for x in (-1, 1)]


def run(spark, folder, checkpoint, out, **kw):
    seen = []
    links = transfer_stream.transfer_links(spark.readStream.schema(SCHEMA).parquet(folder), **kw)
    query = links.writeStream.foreachBatch(lambda batch, k: seen.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    out += seen


def test_links_equal_the_batch_over_restarts(spark, tmp_path):
    rows = sorted(movements(3, 400), key=lambda r: r[2])
    accounts = spark.createDataFrame([("A", "Uno", "Alfa"), ("B", "Dos", "Bancolor"), ("C", "Tres", "Gama")], "account_id string, name string, institution string")
    tokens = transfers.account_tokens(accounts)
    out = []
    for part in (rows[:250], rows[250:], beat(400)):
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, f"{tmp_path}/in", f"{tmp_path}/ck", out, tokens=tokens)
    want = transfers.transfer_links(spark.createDataFrame(rows, SCHEMA), tokens, bucket_cap=10**9)
    want = {tuple(r) for r in want.select("from_id", "to_id", "amount_minor", "currency", "signal", "confidence", "kind").collect()}
    assert len(out) == len(set(out)) and set(out) == want and len(want) > 5
    run(spark, f"{tmp_path}/in", f"{tmp_path}/ck", out, tokens=tokens)
    assert len(out) == len(want)


def test_no_link_before_its_window_closes(spark, tmp_path):
    day = lambda k: DAY0 + dt.timedelta(days=k)
    part = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = []
    one = [("d", "A", day(0), -100, "MXN", "REF00001", "x", "debito"), ("c", "B", day(1), 100, "MXN", "REF00001", "x", "debito"), *beat(3)]
    part(one)
    run(spark, f"{tmp_path}/in", f"{tmp_path}/ck", out, lateness="1 day")
    assert out == []
    # a second candidate of the debit comes in time: the pair is ambiguous; another amount is too common
    part([("e", "C", day(3), 100, "MXN", "REF00001", "x", "debito"), ("f", "A", day(4), -700, "MXN", "REF00002", "x", "debito"), ("g", "B", day(4), 700, "MXN", "REF00002", "x", "debito"), ("h", "A", day(4), -900, "MXN", "REF00002", "x", "debito"), ("i", "B", day(4), 900, "MXN", "REF00002", "x", "debito"), *beat(40)])
    crowded = spark.createDataFrame([(900,)], "amount_minor long")
    run(spark, f"{tmp_path}/in", f"{tmp_path}/ck", out, lateness="1 day")
    assert {r[:2] for r in out} == {("f", "g"), ("h", "i")}
    other = []
    run(spark, f"{tmp_path}/in", f"{tmp_path}/ck2", other, lateness="1 day", crowded=crowded)
    assert ("h", "i") not in {r[:2] for r in other}


def test_late_rows_wait_with_their_delay(spark, tmp_path):
    schema, lateness = "id long, op_ts timestamp", dt.timedelta(days=2)
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    split = late.LateSplit(spark, f"{tmp_path}/out", lateness)
    for part in ([(1, at(10)), (2, at(0)), (3, None)], [(4, at(8)), (5, at(7.5)), (6, at(12))], [(7, at(9.9)), (8, at(10)), (9, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        late.split_late(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", lateness, f"{tmp_path}/ck").awaitTermination()
    assert {r["id"]: r["delay_seconds"] for r in split.quarantined().collect()} == {5: 43200.0, 7: 8640.0}
    assert {r["id"] for r in split.on_time().collect()} == {1, 2, 3, 4, 6, 8, 9}
    # a batch that runs again replaces what it wrote, judged by the same mark
    again = spark.createDataFrame([(4, at(8)), (5, at(7.5)), (6, at(12))], schema)
    split(again, 1)
    assert split.read().count() == 9 and {r["id"] for r in split.quarantined().collect()} == {5, 7}
    assert spark.createDataFrame([(1,)], "a int").select(F.lit(split.mark(2)).alias("m")).first()["m"] == at(12)


def test_links_are_found_without_pairs(spark, tmp_path):
    # brute force over all pairs of one amount, with every kind of signal
    rng = random.Random(5)
    refs = [None, "REF001", "REF0011", "REF00112", "REF", "OTHER01"]
    rows = [(rng.random() < 0.5, f"m{k}", rng.choice("ABCD"), rng.randrange(150), rng.choice(refs), rng.choice([None] * 9 + ["A"]), rng.random() < 0.05, rng.random() < 0.2, False) for k in range(120)]
    related = lambda x, y: x is not None and y is not None and (x == y or min(len(x), len(y)) >= 6 and (x.startswith(y) or y.startswith(x)))
    signal = lambda d, c: related(d[4], c[4]) or d[5] == c[2] or c[5] == d[2] or c[6] or d[7] and c[7]
    pairs = [(d, c) for d in rows if d[0] for c in rows if not c[0] and d[2] != c[2] and abs(d[3] - c[3]) <= 3 and signal(d, c)]
    once = lambda x: sum(x in p for p in pairs) == 1
    found = transfer_stream.SolePairs(3)._links(rows, None, 10**12)
    want = {(d[1], c[1]) for d, c in pairs if once(d) and once(c)}
    assert {(d.id, c.id) for d, c, _ in found} == want and len(want) > 3
    # nothing joins movements with movements, and 20,000 copies on either side take no 400 million pairs
    spark.createDataFrame(movements(3, 4), SCHEMA).write.parquet(f"{tmp_path}/in")
    links = transfer_stream.transfer_links(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    assert "Join" not in links._jdf.queryExecution().analyzed().toString()
    copies = [(k % 2 == 0, f"m{k}", f"a{k}", k % 5, "REF00001", None, False, False, False) for k in range(40_000)]
    assert not list(transfer_stream.SolePairs(3)._links(copies, None, 10**12))
