"""Large statement CSV files as a data source: ``spark.read.format("statement_csv")``.

A file is cut into byte ranges, each read by a task of its own; a range owns the
records that begin in it.  Small files are read several to a task.  Metadata lines
may stand anywhere, the header is read again by every range.  Record numbers are
counted per range; ``statement_rows`` adds those of the ranges before and gives the
rows that ``read_statements`` gives for whole files.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .statements import META_KEYS, ROW, header_columns

_FIELDS = [f for f in ROW.fieldNames() if f not in ("locator", "raw_text")]
SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("range", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("meta_key", T.StringType()), T.StructField("meta_value", T.StringType()),
    T.StructField("raw_text", T.StringType()), *(T.StructField(f, T.StringType()) for f in _FIELDS),
])
_READ = 1 << 20


def filesystem(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """``(path, first byte, byte after the last, number of the range in its file)`` of one task."""

    pieces: list[tuple[str, int, int, int]]


class StatementCsv(DataSource):
    """Options: ``path``, a file or a folder of ``*.csv``, and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "statement_csv"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return StatementCsvReader(self.options["path"], int(self.options.get("rangeBytes", 64 << 20)))


class StatementCsvReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes, self.wanted = path, range_bytes, None

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on ``path`` choose files; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = these if self.wanted is None else self.wanted & these
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        system, base = filesystem(self.path)
        found = system.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.path.lower().endswith(".csv") and not f.base_name.startswith((".", "_"))]
        out, small, held = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if self.wanted is not None and f.path not in self.wanted:
                continue
            if f.size > self.range_bytes:
                out += [Ranges([(f.path, low, min(f.size, low + self.range_bytes), k)]) for k, low in enumerate(range(0, f.size, self.range_bytes))]
                continue
            if small and held + f.size > self.range_bytes:
                out, small, held = [*out, Ranges(small)], [], 0
            small, held = [*small, (f.path, 0, f.size, 0)], held + f.size
        return [*out, *([Ranges(small)] if small else [])] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        system, _ = filesystem(self.path)
        for path, low, high, number in partition.pieces:
            head, title = self._header(system, path)
            columns, nth = header_columns(title), 0
            for at, line in self._lines(system, path, low, high):
                key, value = metadata(line)
                if value is not None:
                    yield (path, number, None, key, value, None, *[None] * len(_FIELDS))
                if line.strip().startswith("#") or at == head:
                    continue
                nth += 1
                if line.count('"') % 2:
                    raise ValueError(f"{path}: a record of several lines begins at {line[:40]!r}; read this file whole, by read_statements")
                cells = next(csv.reader([line]), [])
                if not any(c.strip() for c in cells):
                    continue
                row = {c: cell.strip() for c, cell in zip(columns, cells) if c}
                yield (path, number, nth, None, None, ",".join(cells), *[row.get(f) for f in _FIELDS])
            yield (path, number, nth, None, None, None, *[None] * len(_FIELDS))  # how many records the range has

    def _lines(self, system, path: str, low: int, high: int) -> Iterator[tuple[tuple[int, int], str]]:
        """Places and texts of the lines that begin in a range; the last one is read to its end, wherever that is."""
        with system.open_input_file(path) as file:
            at = max(low - 1, 0)
            file.seek(at)
            rest, skip = b"", low > 0  # the range begins a line only behind a line end
            while True:
                block = file.read(_READ)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                for line in lines:
                    begins, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                        continue
                    if begins >= high:
                        return
                    if not block and not line:
                        continue
                    parts = line.decode("utf-8-sig" if begins == 0 else "utf-8", "replace").splitlines() or [""]
                    yield from (((begins, k), part) for k, part in enumerate(parts))
                if not block:
                    return

    def _header(self, system, path: str) -> tuple[tuple[int, int], str]:
        """The first line that is not metadata, and its place."""
        return next((x for x in self._lines(system, path, 0, 1 << 62) if not x[1].strip().startswith("#")), ((-1, 0), ""))


def metadata(line: str) -> tuple[str | None, str | None]:
    """Key and value of a ``# key: value`` line that is known."""
    s = line.strip()
    key, colon, value = s[1:].partition(":")
    known = key.strip().lower()
    return (known, value.strip()) if s.startswith("#") and colon and known in META_KEYS else (None, None)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatementCsv)


def statement_rows(records: DataFrame) -> DataFrame:
    """``(path, locator, raw_text, fields)`` with record numbers of whole files, from the source's records."""
    counts = records.where("meta_key IS NULL").groupBy("path", "range").agg(F.max("nth").alias("_n"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a file has one row a range
    shifts = counts.select("path", "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = records.where("raw_text IS NOT NULL").join(shifts, ["path", "range"])
    return rows.select("path", F.concat(F.lit("row:"), (F.col("nth") + F.col("_before")).cast("string")).alias("locator"), "raw_text", *_FIELDS)


def statement_metadata(records: DataFrame) -> DataFrame:
    """``(path, meta)``: of a key that stands in a file more than once the last line counts."""
    told = records.where("meta_key IS NOT NULL").withColumn("_at", F.monotonically_increasing_id())
    last = told.groupBy("path", "meta_key").agg(F.max(F.struct("range", "_at", "meta_value")).alias("v"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("meta_key", "v.meta_value"))).alias("meta"))
