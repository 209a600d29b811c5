import gzip
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import queries as Q
from tallyspark.llm.warc import _write_batches, gzip_member, read_warc, record_bytes, salvage, sha1_base32, write_warc


def pages():
    rng = random.Random(1)
    body = lambda n: "".join(rng.choice("abcé <>&\r\n") for _ in range(n))
    same = body(300)
    return [(k, f"http://x/{k} é\n", body(rng.randrange(2000))) for k in range(20)] + [(30, None, None), (31, "u", ""), (32, "u", same), (33, "u", same), (34, "u", same), (40, "big", body(200_000)), (50, "r", "twice"), (50, "r", "twice"), (None, "n", same), (60, "w", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize(("least", "prints"), [(0, 100), (0, 0), (100, 100)])
def test_round_trip(spark, tmp_path, least, prints):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    folder = f"file://{tmp_path}/a"
    (tmp_path / "a").mkdir()
    written = write_warc(df, folder, min_revisit_bytes=least, archive_bytes=1_000, broadcast_prints=prints).collect()
    got = read_warc(spark, folder).collect()
    assert len(written) == len(rows) == len(got) and all(r["kind"] == "record" for r in got)
    groups = {}
    for i, _, t in rows:
        groups.setdefault((t or "").encode(), []).append(i)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        ids = [x for x in groups[data] if x is not None]
        top = max(ids)
        revisit = len(groups[data]) > 1 and len(data) >= least and i != top
        want.append((str(i) if i is not None else "null", len(data), sha1_base32(data), "revisit" if revisit else "response", str(top) if revisit else None, None if revisit else data))
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got), key=str) == sorted(want, key=str)
    assert len({r["archive"] for r in got}) > 3  # archives stay small


def test_empty_table(spark, tmp_path):
    (tmp_path / "e").mkdir()
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert write_warc(df, f"file://{tmp_path}/e").count() == 0
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_a_task_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    folder = f"file://{tmp_path}"

    def batches(keys, fail=False):
        yield pa.RecordBatch.from_pylist([{"key": str(k), "url": "u", "payload": bytes(50), "refers_to": None} for k in keys], pa.schema([("key", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("refers_to", pa.string())]))
        if fail:
            raise OSError("executor lost")

    read = lambda: sorted(int(r["key"]) for r in read_warc(spark, folder).collect())
    with pytest.raises(OSError):
        list(_write_batches(batches(range(9), fail=True), folder, 1, 6))
    assert read() == [] and not list(tmp_path.iterdir())
    list(_write_batches(batches(range(9)), folder, 1, 6))
    assert read() == list(range(9)) and len(list(tmp_path.glob("part-*/*"))) == 9
    list(_write_batches(batches(reversed(range(9))), folder, 400, 6))  # other order, fewer files
    assert read() == list(range(9)) and 1 < len(list(tmp_path.glob("part-*/*"))) < 9
    with pytest.raises(OSError):
        list(_write_batches(batches(range(9), fail=True), folder, 1, 6))
    assert read() == list(range(9))


def archive(packed):
    records = [record_bytes(str(k), "http://x", bytes([65 + k]) * (50 * k + 1), sha1_base32(bytes([65 + k]) * (50 * k + 1)), None) for k in range(8)]
    return [gzip_member(r) if packed else r for r in records]


def survey(content):
    found, at = [], 0
    for kind, offset, length, head, _ in salvage(content):
        assert offset == at  # records and gaps cover all bytes
        at += length
        found.append(kind if kind == "gap" else int(head["warc-record-id"].strip("<>").rsplit(":", 1)[1]))
    assert at == len(content)
    return found


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = archive(packed)
    assert survey(b"".join(parts)) == list(range(8))
    cut = b"".join([*parts[:3], parts[3][: len(parts[3]) // 2], *parts[4:]])
    assert survey(cut) == [0, 1, 2, "gap", 4, 5, 6, 7]
    flipped = bytearray(parts[5])
    flipped[len(flipped) // 2] ^= 0x5A
    assert survey(b"".join([*parts[:5], bytes(flipped), *parts[6:]])) == [0, 1, 2, 3, 4, "gap", 6, 7]
    assert survey(b"junk" * 9 + b"".join(parts[:2]) + b"tail") == ["gap", 0, 1, "gap"]
    assert survey(b"".join(parts)[:-7])[-1] == "gap"
    assert survey(b"") == [] and survey(b"no archive") == ["gap"]


def test_other_writers_members():
    both = gzip.compress(b"".join(archive(False)[:2])) + gzip.compress(archive(False)[2])
    kinds = [(k, o) for k, o, *_ in salvage(both)]
    assert [k for k, _ in kinds] == ["record"] * 3


def test_query_keeps_pages_of_awkward_urls_and_fails_on_gaps(spark, tmp_path, monkeypatch):
    urls = ["http://a/WARC/1.1", "WARC/1.0", "http://a/" + "é" * 200_000, "http://b/"]
    spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["page_id"] for r in Q.op2_warc(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    monkeypatch.setattr(Q, "read_warc", lambda spark, folder, payloads: read_warc(spark, folder, payloads).withColumn("kind", F.lit("gap")))
    with pytest.raises(Exception, match="gap in"):
        Q.op2_warc(spark, str(tmp_path))


@pytest.mark.parametrize("cut", [3, 12, 20, 40, 90])
def test_cut_headers_are_not_joined_with_the_next_record(cut):
    parts = archive(False)
    assert survey(b"".join([*parts[:3], parts[3][:cut], *parts[4:]])) == [0, 1, 2, "gap", 4, 5, 6, 7]


def test_salvage_inside_members():
    def inside(content):
        return [k if k == "gap" else int(h["warc-record-id"].strip("<>").rsplit(":", 1)[1]) for k, _, _, h, _ in salvage(content)]

    parts = archive(False)
    bad = [*parts[:3], parts[3].replace(b"DDDD", b"DDDE"), *parts[4:]]
    assert inside(gzip.compress(b"".join(bad))) == [0, 1, 2, "gap", 4, 5, 6, 7]
    assert inside(gzip.compress(b"".join(bad[:5])) + gzip.compress(b"".join(parts[5:]))) == [0, 1, 2, "gap", 4, 5, 6, 7]
    # a member that is cut keeps what comes before the cut, and the next member is found
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = z.compress(b"".join(parts)) + z.flush()
    cut = stored[: stored.index(parts[6]) + 100]
    assert inside(cut) == [0, 1, 2, 3, 4, 5, "gap"]
    assert inside(cut + gzip_member(parts[7])) == [0, 1, 2, 3, 4, 5, "gap", 7]
    assert inside(stored[:-4]) == [*range(8), "gap"]
    # a member whose check sum differs: the digest tells which record is bad
    assert inside(stored.replace(b"DDDD", b"DDDE")) == [0, 1, 2, "gap", 4, 5, 6, 7]
    # here no digest tells, so none of its records is taken
    assert inside(stored.replace(b"http://x", b"http://y", 1)) == ["gap"]
