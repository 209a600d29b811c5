"""WARC archives: a deduplicating writer and a salvaging reader.

Archives are written by the executors through ``pyarrow.fs`` into a folder all
of them share, one gzip member per record, under names that only depend on the
partition, so a repeated task replaces its own files.  The reader takes whole
archives (their size is bounded by the writer) and checks every record: gzip
CRC, version line, lengths and block digest.  After a failed check it searches
for the next version line, inside a gzip member too, or the next gzip member that
holds, goes on from there and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import durable, spread_join

#: So many prints, of some hundred bytes each, may be broadcast.
BROADCAST_PRINTS = 100_000
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields that a record has once; a second one behind a version line is the next record's.
_ONCE = {"warc-record-id", "warc-type", "warc-date", "content-length"}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(c if 0x21 <= ord(c) < 0x7F and c not in "<>" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")


def record_bytes(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-record:{key}>", f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url else []),
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-record:{refers_to}>"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archives:
    """Files of one task, a new one beyond ``limit`` bytes, in a folder of the attempt that gets the partition's name once all are whole.

    An attempt that fails leaves nothing readers see, and one that runs again,
    after a lost executor or beside a slow one, replaces the folder as a whole: its
    rows may come in another order and fill another number of files.
    """

    def __init__(self, folder: str, limit: int):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.limit, self.number, self.out, self.size = limit, 0, None, 0
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        self.part, self.draft = f"part-{part:05d}", f"{self.path}/_draft-{part:05d}-{attempt}"

    def write(self, data: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name = f"{self.part}/{self.number:04d}.warc.gz"
            self.fs.create_dir(self.draft)
            self.out, self.size = self.fs.open_output_stream(f"{self.draft}/{self.number:04d}.warc.gz", compression=None), 0
            self.number += 1
        at = self.name, self.size
        self.out.write(data)
        self.size += len(data)
        if self.size >= self.limit:
            self._end_file()
        return at

    def _end_file(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def publish(self) -> None:
        self._end_file()
        self._remove(f"{self.path}/{self.part}")
        if self.number:
            self.fs.move(self.draft, f"{self.path}/{self.part}")

    def discard(self) -> None:
        self._end_file()
        self._remove(self.draft)

    def _remove(self, path: str) -> None:
        if self.fs.get_file_info(path).type.name == "Directory":
            self.fs.delete_dir(path)


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, limit: int, level: int) -> Iterator[pa.RecordBatch]:
    archives = _Archives(folder, limit)
    try:
        for batch in batches:
            places, sizes = [], []
            ids, urls, payloads, refers = (batch.column(c) for c in ("key", "url", "payload", "refers_to"))
            for key, url, payload, refer in zip(ids, urls, payloads, refers):
                data = payload.as_py() or b""
                member = gzip_member(record_bytes(key.as_py(), url.as_py(), data, sha1_base32(data), refer.as_py()), level)
                places.append(archives.write(member))
                sizes.append(len(member))
            yield pa.RecordBatch.from_arrays([ids, pa.array([p[0] for p in places], pa.string()), pa.array([p[1] for p in places], pa.int64()), pa.array(sizes, pa.int64())], names=["key", "archive", "offset", "length"])
        archives.publish()
    except BaseException:
        archives.discard()
        raise


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = 16 << 20, level: int = 6, broadcast_prints: int = BROADCAST_PRINTS) -> DataFrame:
    """Plan that writes a record per row and gives ``(key, archive, offset, length)``; run it once, into a folder of its own.

    Each task's archives appear together, in a folder ``part-<n>``, when it ends.

    ``payload_col`` is text (written in UTF-8) or binary; null is empty.  Of rows
    with equal payloads of ``min_revisit_bytes`` or more, the one with the largest
    id is the response and the others revisit it; smaller ones are all responses.
    A null id is below all others; rows that repeat an id and payload have equal
    records and are all responses if that id is the largest.

    Up to ``broadcast_prints`` payloads that are found twice are broadcast, by
    print, so pages stay where they are read; beyond that pages are shuffled by
    print, those of very frequent ones apart.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    known = F.concat_ws("-", F.sha1(payload), F.length(payload).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), known.alias("print"))
    # only prints found twice are joined: a page with a payload of its own finds no partner
    twice = rows.where(F.length("payload") >= min_revisit_bytes).groupBy("print").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = durable(twice)
    if twice.count() <= broadcast_prints:
        told = rows.join(F.broadcast(twice.drop("n")), "print", "left")
    else:
        told = spread_join(rows, twice, "print", "n", "left")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), key("first"))
    out = told.select(key("id").alias("key"), "url", "payload", refers.alias("refers_to"))
    return out.mapInArrow(partial(_write_batches, folder=folder, limit=archive_bytes, level=level), "key string, archive string, offset long, length long")


class _Bad(ValueError):
    pass


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``at``, or ``_Bad``."""
    version = _VERSION.match(data, at)
    if not version:
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise _Bad("no end of headers")
    # a field's value, such as a URL, may end like a version line
    inside = _VERSION.search(data, version.end(), end + 2)
    head = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise _Bad("bad header line")
        name = name.strip().lower().decode("latin-1")
        if inside and name in head and name in _ONCE:
            raise _Bad("another record begins inside the headers")
        head[name] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise _Bad("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("block is cut or has another length")
    block = data[start:stop]
    wanted = head.get("warc-block-digest", "")
    if wanted.lower().startswith("sha1:") and wanted[5:].upper() != sha1_base32(block):
        raise _Bad("block digest differs")
    return head, block, stop + 4


def _members(content: bytes, at: int) -> tuple[bytes, int]:
    """The data of the gzip member at ``at`` and where it ends, or ``_Bad``."""
    z = zlib.decompressobj(31)
    try:
        data = z.decompress(memoryview(content)[at:])
    except zlib.error as e:
        raise _Bad(str(e)) from None
    if not z.eof:
        raise _Bad("member is cut")
    return data, len(content) - len(z.unused_data)


def _partial(content: bytes, at: int) -> tuple[bytes, bool]:
    """What can be unpacked of a member that fails, and whether it was only cut: then the data up to the cut is sound."""
    z, out, step = zlib.decompressobj(31), [], 1 << 14
    try:
        while at < len(content) and not z.eof:
            before = z.copy()
            out.append(z.decompress(content[at : at + step]))
            at += step
    except zlib.error:
        try:
            for k in range(at, min(at + step, len(content))):
                out.append(before.decompress(content[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out), False
    return b"".join(out), True


def _plain(data: bytes) -> Iterator[tuple]:
    """``salvage`` of plain data."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            head, block, end = _parse(data, at)
            if lost is not None and data[at - 1] != 10 and "warc-record-id" not in head:
                raise _Bad("version line inside a header")
        except _Bad as e:
            if lost is None:
                lost, why = at, str(e)
            m = _VERSION.search(data, at + 1)
            if not m:
                break
            at = m.start()
            continue
        if lost is not None:
            yield "gap", lost, at - lost, why, b""
            lost = None
        yield "record", at, end - at, head, block
        at = end
    if lost is not None:
        yield "gap", lost, len(data) - lost, why, b""


def _member_parts(content: bytes, at: int) -> tuple[list[tuple], int]:
    """Records and inner gaps of the gzip member at ``at``, and where it ends, or ``_Bad`` if no record is found.

    Of a damaged member only records whose block digest holds are taken, and none
    if no record shows where the damage is; it ends at the next member's mark.
    """
    if content[at : at + 3] != _GZIP:
        raise _Bad("no gzip member")
    failed = ""
    # a member is tried in a bounded slice first, so a long archive is not copied for every record
    for width in (1 << 16, 1 << 20, len(content)):
        try:
            data, used = _members(content[at : at + width], 0)
            end = at + used
            break
        except _Bad as e:
            if at + width >= len(content):
                failed = str(e)
                break
    if failed:
        data, cut = _partial(content, at)
        found = content.find(_GZIP, at + 1)
        end = found if found >= 0 else len(content)
    parts = list(_plain(data))
    if failed:
        sound = lambda p: p[0] == "gap" or p[3].get("warc-block-digest", "").lower().startswith("sha1:")
        parts = [p if sound(p) else ("gap", p[1], p[2], "no digest in a damaged member", b"") for p in parts]
        if not cut and all(p[0] == "record" for p in parts):
            raise _Bad(failed)
    if all(p[0] == "gap" for p in parts):
        raise _Bad(failed or (parts[0][3] if parts else "empty member"))
    told = [(kind, at, end - at, head if kind == "record" else f"{head}, bytes {lo} to {lo + size} of the member's data", block) for kind, lo, size, head, block in parts]
    return told + ([("gap", end, 0, failed, b"")] if failed and parts[-1][0] == "record" and cut else []), end


def salvage(content: bytes) -> Iterator[tuple]:
    """Yields ``("record", offset, length, headers, block)`` and ``("gap", offset, length, reason, b"")`` in order; together they cover all bytes.

    Records of one gzip member all have its offset and length, and so have gaps
    between them, whose reason tells the place in the member's data.  A member cut
    after a whole record is followed by a gap of length 0.
    """
    if not (content[:3] == _GZIP or (_GZIP in content and not _VERSION.search(content))):
        yield from _plain(content)
        return
    at, lost, why = 0, None, ""
    while at < len(content):
        try:
            parts, end = _member_parts(content, at)
        except _Bad as e:
            if lost is None:
                lost, why = at, str(e)
            at = content.find(_GZIP, at + 1)
            if at < 0:
                break
            continue
        if lost is not None:
            yield "gap", lost, at - lost, why, b""
            lost = None
        yield from parts
        at = end
    if lost is not None:
        yield "gap", lost, len(content) - lost, why, b""


_FIELDS = [
    ("archive", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("key", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
]
_SCHEMA = "archive string, kind string, offset long, length long, reason string, key string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def _urn(text: str | None) -> str | None:
    return text.strip("<>").removeprefix("urn:x-record:") if text else None


def _describe(head: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    digest = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return None, int(size[1]) if size else None, digest[5:] if digest.lower().startswith("sha1:") else None
    return payload, len(payload), sha1_base32(payload)


def _read_batches(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FIELDS)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), _FIELDS)], schema=schema)

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, held = [], 0
            for kind, offset, length, head, block in salvage(content.as_py() or b""):
                if kind == "gap":
                    rows.append((path.as_py(), kind, offset, length, head, None, None, None, None, None, None, None))
                else:
                    payload, size, digest = _describe(head, block)
                    rows.append((path.as_py(), kind, offset, length, None, _urn(head.get("warc-record-id")), head.get("warc-type"), _urn(head.get("warc-refers-to")), head.get("warc-target-uri"), size, digest, payload if payloads else None))
                    held += len(payload or b"") if payloads else 0
                if len(rows) >= 10_000 or held > (8 << 20):
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, pattern: str = "*.warc*") -> DataFrame:
    """All records and gaps of the archives in a folder and the folders in it: ``kind`` is ``record`` or ``gap``.

    Gaps have the archive, offset, length and the reason of the first failed
    check.  A revisit has the size and digest of the payload it stands for and no
    payload.  An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(partial(_read_batches, payloads=payloads), _SCHEMA)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
