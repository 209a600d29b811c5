import hashlib
import json

from pyspark.sql import functions as F

from tallyspark import store as stores


def expected(hashes, fan):
    """The digest that text hashes give, group by group."""
    n = total = len(hashes)
    while n > 1:
        depth = 0
        while n > fan * 16**depth:
            depth += 1
        groups = {}
        for h in hashes:
            groups.setdefault(h[:depth], []).append(h)
        hashes = [hashlib.sha256("".join(sorted(g)).encode()).hexdigest() for g in groups.values()]
        n = len(hashes)
    return hashlib.sha256(f"id,name|{total}|{hashes[0] if hashes else ''}".encode()).hexdigest()


def test_digests_keep_their_value(spark, monkeypatch):
    monkeypatch.setattr(stores, "_FAN", 8)
    for n in (0, 1, 2, 300):
        df = spark.range(n).select("id", F.concat(F.lit("ñ"), "id").alias("name"))
        said = [{"id": k, "name": f"ñ{k}"} for k in range(n)]
        hashes = [hashlib.sha256(json.dumps(r, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for r in said]
        assert len(set(hashes)) == n
        assert stores.content_digest(df.repartition(3)) == expected(hashes, 8)


def test_hashes_are_shuffled_as_bytes(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(stores, "durable", lambda df: kept.append(df.schema["h"].dataType.typeName()) or df)
    stores.content_digest(spark.range(3))
    assert set(kept) == {"binary"}
