"""Statement files to raw statements.

``discover`` lists files with their hash; ``read_csv`` parses files with
``# key: value`` lines and a header of synonyms; other binary formats go through
the same boundary if their library is there.  Every row keeps its locator.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable

# Headers by canonical column, keys of metadata lines.
HEADERS = {
    "date_op": ("date_op", "fecha", "fecha_operacion", "fecha operación", "fecha_op"),
    "date_post": ("date_post", "fecha_cargo", "fecha_procesamiento", "fecha proceso"),
    "date_value": ("date_value", "fecha_valor"),
    "description": ("description", "descripcion", "descripción", "concepto", "detalle"),
    "amount": ("amount", "monto", "importe", "cargo_abono", "movimiento"),
    "balance": ("balance", "saldo"),
    "bank_ref": ("bank_ref", "ref", "folio", "referencia", "autorizacion", "autorización"),
}
META_KEYS = ("account_id", "currency", "period_start", "period_end", "opening_balance", "closing_balance", "declared_credits", "declared_debits", "declared_count")
#: An amount with two decimals.
AMOUNT = r"[0-9][0-9,]*\.[0-9]{2}"
EXTENSIONS = ("pdf", "csv", "xlsx", "xls", "png", "jpg", "jpeg")

_CANONICAL = {name: column for column, names in HEADERS.items() for name in names}
_FIELDS = ("date_op", "date_post", "date_value", "description", "amount", "balance", "bank_ref")
ROW = T.StructType([T.StructField("locator", T.StringType()), T.StructField("raw_text", T.StringType()), *(T.StructField(f, T.StringType()) for f in _FIELDS)])
RAW = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("file_sha256", T.StringType()), T.StructField("method", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rows", T.ArrayType(ROW)), T.StructField("warnings", T.ArrayType(T.StringType())),
])


def discover(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """``(path, ext, length, file_sha256, content)`` of the files of a folder that may be statements."""
    names = ",".join("*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "{" + names + "}").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", ext.alias("ext"), "length", F.sha2("content", 256).alias("file_sha256"), "content")


def header_columns(line: str) -> list[str | None]:
    """Canonical columns of a CSV header line, null for unknown ones."""
    return [_CANONICAL.get(h.strip().lower()) for h in next(csv.reader([line]), [])]


def table_rows(lines: list[list[str]], where: str = "row:") -> tuple[list[dict], list[str]]:
    """Rows of a table whose first line is a header; blank rows are skipped but counted."""
    rows, warnings = [], []
    if not lines:
        return rows, warnings
    columns = [_CANONICAL.get((h or "").strip().lower()) for h in lines[0]]
    for k, cells in enumerate(lines[1:], 1):
        if not any((c or "").strip() for c in cells):
            continue
        row = dict.fromkeys(ROW.fieldNames()) | {"locator": f"{where}{k}", "raw_text": ",".join(c or "" for c in cells)}
        row |= {column: (cell or "").strip() for column, cell in zip(columns, cells) if column}
        if row["date_op"] is None or row["amount"] is None:
            warnings.append(f"{where}{k} sin fecha o importe")
        rows.append(row)
    return rows, warnings


def parse_csv(content: bytes) -> dict:
    """Metadata, rows and warnings of one file; metadata lines may stand anywhere."""
    meta, data = {}, []
    for line in content.decode("utf-8-sig", "replace").splitlines():
        s = line.strip()
        if not s.startswith("#"):
            data.append(line)
            continue
        key, colon, value = s[1:].partition(":")
        if colon and key.strip().lower() in META_KEYS:
            meta[key.strip().lower()] = value.strip()
    rows, warnings = table_rows(list(csv.reader(io.StringIO("\n".join(data)))))
    return {"method": "csv", "meta": meta, "rows": rows, "warnings": warnings}


def parse_xlsx(content: bytes) -> dict:
    """All sheets with a date and an amount header, and a sheet ``meta`` of keys and values; needs openpyxl."""
    import openpyxl

    book = openpyxl.load_workbook(io.BytesIO(content), data_only=True, read_only=True)
    text = lambda v: "" if v is None else v.strftime("%Y-%m-%d") if hasattr(v, "strftime") else str(v)
    meta, rows, warnings, used = {}, [], [], 0
    for sheet in book.worksheets:
        lines = [[text(v) for v in r] for r in sheet.iter_rows(values_only=True)]
        if sheet.title.strip().lower() == "meta":
            meta |= {r[0].strip().lower(): r[1].strip() for r in lines if len(r) > 1 and r[0].strip().lower() in META_KEYS}
            continue
        start = next((k for k, r in enumerate(lines) if {"date_op", "amount"} <= {_CANONICAL.get(c.strip().lower()) for c in r}), None)
        if start is not None:
            got, said = table_rows(lines[start:], f"{sheet.title}!row:")
            rows, warnings, used = rows + got, warnings + said, used + 1
    if used > 1:
        warnings.append(f"{used} hojas con movimientos")
    return {"method": "xlsx", "meta": meta, "rows": rows, "warnings": warnings}


#: Parsed rows and files that a task's Python holds before it hands them on; a file is one row of the result, so one file may have more.
_PARSED_ROWS = 2_000
PARSERS = {"csv": parse_csv, "xlsx": parse_xlsx, "xls": parse_xlsx}


def _parse_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files come many at a time, but what was parsed is handed on as soon as it has ``_PARSED_ROWS`` rows."""
    for frame in frames:
        out, n = [], 0
        for path, ext, digest, content in zip(frame["path"], frame["ext"], frame["file_sha256"], frame["content"]):
            try:
                got = PARSERS[ext](content)
            except (KeyError, ImportError, ValueError, OSError) as e:
                got = {"method": f"unreadable:{ext}", "meta": {}, "rows": [], "warnings": [f"{type(e).__name__}: {e}"]}
            out.append({"path": path, "file_sha256": digest, **got})
            n += 1 + len(got["rows"])
            if n >= _PARSED_ROWS:
                yield pd.DataFrame(out, columns=RAW.fieldNames())
                out, n = [], 0
        if out:
            yield pd.DataFrame(out, columns=RAW.fieldNames())


def read_statements(files: DataFrame) -> DataFrame:
    """Raw statements of discovered files; a file that can't be read has no rows and a warning."""
    return files.select("path", "ext", "file_sha256", "content").mapInPandas(_parse_files, RAW)


def read_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)`` of text files, the form PDF text takes once it was extracted elsewhere."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def unusable_text(text: Column) -> Column:
    """A long text without a single amount: its glyphs are not its characters."""
    return (F.length(F.trim(text)) >= 500) & ~text.rlike(AMOUNT)


def decode_ebcdic(data: bytes) -> tuple[str, bool]:
    """Text of cp037 bytes, and whether it is good: few unknown characters and an amount."""
    import re

    text = data.decode("cp037", "replace")
    strange = sum(1 for c in text if not (c.isprintable() or c in "\n\r\t"))
    return text, bool(text) and strange <= 0.05 * len(text) and re.search(r"\d[\d,]*\.\d{2}", text) is not None


# Characters of the standard encoding of fonts whose code is not their ASCII one.
STANDARD_ENCODING = {
    39: "’", 96: "‘", 161: "¡", 162: "¢", 163: "£", 164: "⁄", 165: "¥", 166: "ƒ", 167: "§", 168: "¤", 169: "'", 170: "“", 171: "«", 172: "‹", 173: "›", 174: "ﬁ", 175: "ﬂ", 177: "–", 178: "†",
    179: "‡", 180: "·", 182: "¶", 183: "•", 184: "‚", 185: "„", 186: "”", 187: "»", 188: "…", 189: "‰", 191: "¿", 193: "`", 194: "´", 195: "ˆ", 196: "˜", 197: "¯", 198: "˘", 199: "˙", 200: "¨",
    202: "˚", 203: "¸", 205: "˝", 206: "˛", 207: "ˇ", 208: "—", 225: "Æ", 227: "ª", 232: "Ł", 233: "Ø", 234: "Œ", 235: "º", 241: "æ", 245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß",
}
_CODES = {chr(k): k for k in range(32, 127) if k not in STANDARD_ENCODING} | {c: k for k, c in STANDARD_ENCODING.items()}


def ebcdic(data: Column) -> Column:
    """Struct ``(line, good)`` of ``decode_ebcdic``."""

    @F.pandas_udf("line string, good boolean")
    def decoded(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_ebcdic(bytes(v or b"")) for v in values], columns=["line", "good"])

    return decoded(data)


def glyph_character(glyph: str | None) -> str | None:
    """The character of a mainframe glyph, printed as ``(cid:N)`` or as what its code means in the font; null if unknown."""
    code = int(glyph[5:-1]) if glyph and glyph.startswith("(cid:") and glyph[5:-1].isdigit() else _CODES.get(glyph or "")
    return bytes([code]).decode("cp037", "replace") if code is not None and code < 256 else None


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """``(page, line_no, line, unknown)`` of glyphs ``(page, top, x0, x1, text)``: rows of two points, gaps as one to three spaces, ``?`` for unknown glyphs."""

    @F.pandas_udf("string")
    def character(text: pd.Series) -> pd.Series:
        return text.map(glyph_character)

    order = Window.partitionBy("page", "line_no").orderBy("x0", "x1")
    rows = glyphs.withColumn("line_no", F.bround(F.col("top") / 2).cast("long")).withColumn("_c", character("text")).withColumn("_gap", F.col("x0") - F.lag("x1").over(order))
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))
    spaces = F.when(F.col("_gap") > width * 0.5, F.least(F.lit(3), F.greatest(F.lit(1), (F.col("_gap") / width).cast("int")))).otherwise(0)
    part = F.struct("x0", "x1", F.concat(F.repeat(F.lit(" "), spaces), F.coalesce("_c", F.lit("?"))).alias("c"))
    joined = rows.groupBy("page", "line_no").agg(F.array_sort(F.collect_list(part)).alias("_parts"), F.count_if(F.col("_c").isNull()).alias("unknown"))
    return joined.select("page", "line_no", F.rtrim(F.array_join(F.transform("_parts", lambda x: x["c"]), "")).alias("line"), "unknown")


def mainframe_documents(glyphs: DataFrame, share: float = 0.05) -> DataFrame:
    """``(doc_id, text)`` of glyphs with a ``doc_id``: documents with few unknown glyphs and an amount; the others are left to recognition."""
    key = F.struct("doc_id", F.col("page").alias("p")).alias("page")
    lines = glyph_lines(glyphs.select(key, "top", "x0", "x1", "text")).select(F.col("page.doc_id").alias("doc_id"), F.col("page.p").alias("p"), "line_no", "line", "unknown")
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "line_no", "line"))).alias("l"), F.sum("unknown").alias("unknown"), F.sum(F.length(F.replace("line", F.lit(" "), F.lit("")))).alias("n"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return whole.select("doc_id", text.alias("text"), "unknown", "n").where((F.col("unknown") <= share * F.col("n")) & F.col("text").rlike(AMOUNT)).select("doc_id", "text")


def page_statistics(words: DataFrame) -> DataFrame:
    """``(page, confidence, mean, font)``: the worst and the mean confidence of a page's words, and its most frequent font, the first by name among equals."""
    return words.groupBy("page").agg(F.min("confidence").alias("confidence"), F.avg("confidence").alias("mean"), F.mode("font", True).alias("font"))


def recognised(documents: DataFrame, engine: Callable[[bytes, int], list[tuple[str, float]]], resolutions: Sequence[int] = (500, 400, 300), max_bytes: int = 40 << 20, least_confidence: int = 40) -> DataFrame:
    """``(doc_id, line_no, line, confidence, doubtful)`` of images and scans ``(doc_id, content)`` by an optical engine.

    ``engine(content, dpi)`` gives lines with the least confidence of their words;
    it runs on the executors.  Lines of the first resolution are checked against
    the others; larger contents than ``max_bytes`` give no lines, by rule.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (d, dpi, k, line, int(sure)) for d, content in zip(frame["doc_id"], frame["content"]) if len(content) <= max_bytes
                for dpi in resolutions for k, (line, sure) in enumerate(engine(bytes(content), dpi), 1)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "dpi", "line_no", "line", "confidence"])

    lines = durable(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(read, "doc_id string, dpi int, line_no int, line string, confidence int"))
    first, others = lines.where(F.col("dpi") == resolutions[0]).drop("dpi"), lines.where(F.col("dpi") != resolutions[0]).drop("dpi")
    return cross_check_ocr(first, others, least_confidence)


def needs_recognition(docs: DataFrame, movements: DataFrame) -> DataFrame:
    """Documents without a movement whose text has unmapped glyphs: they are read again by recognition."""
    return docs.where(F.col("text").contains("(cid:")).join(movements.select("doc_id").distinct(), "doc_id", "left_anti")


def without_overlay(words: DataFrame) -> DataFrame:
    """Words of ``(page, top, x0, x1, font, text)`` less those of a watermark.

    Words are bucketed by ``round(top / 3)``; where two fonts overlap by more than
    half a point, only the page's dominant font stays in that row.
    """
    rows = words.withColumn("_row", F.round(F.col("top") / 3).cast("int"))
    line = Window.partitionBy("page", "_row").orderBy("x0", "x1")
    # sorted by x0, a word overlaps an earlier one of another font if that font's furthest end is beyond its start
    ends = rows.withColumn("_end", F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_font", F.max_by("font", "x1").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    hit = (F.col("_end") - F.col("x0") > 0.5) & (F.col("_font") != F.col("font"))
    marked = ends.withColumn("_hit", F.max(F.coalesce(hit, F.lit(False)).cast("int")).over(Window.partitionBy("page", "_row")))
    dominant = rows.groupBy("page").agg(F.mode("font", True).alias("_main"))
    return marked.join(dominant, "page").where((F.col("_hit") == 0) | (F.col("font") == F.col("_main"))).select(*words.columns)


def cross_check_ocr(primary: DataFrame, other: DataFrame, least_confidence: int = 40) -> DataFrame:
    """Lines of ``(doc_id, line_no, line, confidence)`` with ``doubtful``: date and last two amounts not confirmed by another resolution, or neither and low confidence."""
    def signed_off(df: DataFrame) -> DataFrame:
        amounts = F.regexp_extract_all("line", F.lit(AMOUNT), F.lit(0))
        date = F.regexp_extract("line", r"^\s*([0-9]{1,2}[/\- ][A-Za-z0-9]{2,4}(?:[/\- ][0-9]{2,4})?)", 1)
        return df.withColumn("_sig", F.when((date != "") | (F.size(amounts) > 0), F.concat_ws("|", date, F.slice(amounts, F.greatest(F.size(amounts) - 1, F.lit(1)), 2))))

    seen = signed_off(other).select("doc_id", "_sig").where("_sig IS NOT NULL").distinct().withColumn("_ok", F.lit(True))
    out = signed_off(primary).join(seen, ["doc_id", "_sig"], "left")
    return out.withColumn("doubtful", F.when(F.col("_sig").isNull(), F.col("confidence") < least_confidence).otherwise(F.col("_ok").isNull())).drop("_sig", "_ok")


def flag_rows_of_doubtful_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` with ``doubtful`` also where all amounts of ``raw_text`` are those of a doubtful line."""
    amounts = lambda c: F.concat_ws("|", F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)))
    bad = lines.where("doubtful").select("doc_id", amounts(F.col("line")).alias("_amounts")).where("_amounts <> ''").distinct().withColumn("_bad", F.lit(True))
    out = rows.withColumn("_amounts", amounts(F.col("raw_text"))).join(bad, ["doc_id", "_amounts"], "left")
    return out.withColumn("doubtful", F.coalesce("doubtful", F.lit(False)) | F.col("_bad").isNotNull()).drop("_amounts", "_bad")
