import pytest
from pyspark.sql import functions as F

from tallyspark.sources import statement_csv as S
from tallyspark.sources.statements import discover, read_statements

A = "﻿# account_id: one\n# note: x\nFecha,Concepto,Monto,Folio,Otra\n2026-01-01,\"a, b\",1.00,r1,z\n\n,,,,\n2026-01-02,éñ 漢字,2.00,,\n# currency: MXN\n2026-01-03,c\x0b2026-01-04,d,4.00\r\n 2026-01-05 ,e,5.00,r5,q\n# currency: USD"
B = "date_op,amount\n" + "".join(f"2026-02-{1 + k % 28:02d},{k}.00\n" for k in range(3000))


@pytest.fixture()
def folder(tmp_path):
    for name, text in (("a.csv", A), ("b.CSV", B), ("c.csv", ""), ("d.csv", "fecha,importe"), ("e.csv", "\n\nfecha,importe\n1,2\n"), ("skip.txt", "x")):
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    return str(tmp_path)


def whole(spark, folder):
    """Rows and metadata as files read whole give them."""
    raw = read_statements(discover(spark, folder, ("csv",))).select(F.regexp_replace("path", "^file:", "").alias("path"), "rows", "meta")
    rows = raw.select("path", F.explode("rows").alias("r")).select("path", "r.*")
    return {tuple(r) for r in rows.collect()}, {r["path"]: r["meta"] for r in raw.collect() if r["meta"]}


def test_rows_of_ranges_equal_rows_of_whole_files(spark, folder):
    S.register(spark)
    records = spark.read.format("statement_csv").option("rangeBytes", 4000).load(folder)
    rows, meta = whole(spark, folder)
    got = [tuple(r) for r in S.statement_rows(records).collect()]
    assert set(got) == rows and len(got) == len(rows) > 3000
    assert {r["path"]: r["meta"] for r in S.statement_metadata(records).collect()} == meta
    assert records.rdd.getNumPartitions() > 8


@pytest.mark.parametrize("size", [1, 2, 3, 7, 31, 64, 1000])
def test_every_record_belongs_to_one_range_wherever_files_are_cut(folder, size):
    def read(size):
        reader = S.StatementCsvReader(folder, size)
        parts = reader.partitions()
        return len(parts), [r for p in parts for r in reader.read(p) if not r[0].endswith("b.CSV") or size > 30]

    n, got = read(size)
    _, want = read(1 << 30)
    content = lambda rows: sorted(((r[0], *r[3:]) for r in rows if (r[3] or r[5] is not None) and (size > 30 or not r[0].endswith("b.CSV"))), key=str)
    assert content(got) == content(want) and n > 3


def test_a_path_filter_chooses_files(spark, folder):
    S.register(spark)
    records = spark.read.format("statement_csv").option("rangeBytes", 1000).load(folder)
    one = records.where(F.col("path") == f"{folder}/e.csv")
    assert one.rdd.getNumPartitions() == 1 and S.statement_rows(one).count() == 2
    reader = S.StatementCsvReader(folder, 1000)
    assert list(reader.pushFilters([S.In(("path",), (f"{folder}/a.csv", f"{folder}/e.csv"))])) == [] and [len(p.pieces) for p in reader.partitions()] == [2]


def test_records_of_several_lines_are_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text('fecha,importe\n"2026\n-01",3\n')
    S.register(spark)
    with pytest.raises(Exception, match="several lines"):
        spark.read.format("statement_csv").load(str(tmp_path)).collect()


def test_parsed_files_are_handed_on_in_bounded_frames():
    import pandas as pd

    from tallyspark.sources import statements

    content = ("# account_id: a\nFecha,Concepto,Importe\n" + "2026-01-01,x,1.00\n" * 500).encode()
    files = pd.DataFrame({"path": [f"/{k}.csv" for k in range(40)], "ext": ["csv"] * 40, "file_sha256": ["d"] * 40, "content": [content] * 40})
    got = list(statements._parse_files(iter([files])))
    assert [p for f in got for p in f["path"]] == list(files["path"]) and all(len(r) == 500 for f in got for r in f["rows"])
    assert max(sum(map(len, f["rows"])) for f in got) <= 2_500
