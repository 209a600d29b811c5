"""Whole-batch text kernels over Arrow string buffers.

An Arrow string column is one byte buffer plus offsets.  Everything here works
on that pair with numpy, so a batch of thousands of documents is tokenised and
hashed without creating a Python string per word.  Functions take

* ``buf``      uint8 array with at least ``PAD`` zero bytes after the text,
* ``offsets``  int64 array, one more entry than there are documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib

import numpy as np
import pyarrow as pa

PAD = 40
#: Text bytes that one kernel call handles, unless one document is longer.
CHUNK_BYTES = 4 << 20
#: Longer spans are hashed one by one with a library function.
LONG_SPAN = 2048

_ALL = np.arange(256)
#: ``[^\x20\x09-\x0D]`` as a table over bytes (UTF-8 continuation bytes are word bytes).
IS_WORD = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z.
IS_ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def column_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, padded buffer, offsets) of slices of about ``limit`` bytes."""
    raw, offsets = column_buffer(col)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        buf = np.zeros(offsets[hi] - offsets[lo] + PAD, np.uint8)
        buf[: len(buf) - PAD] = raw[offsets[lo] : offsets[hi]]
        yield lo, hi, buf, offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def map_chunks(batches: Iterator[pa.RecordBatch], text: str, kernel: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Run ``kernel(rows, buf, offsets) -> dict of columns`` over slices of every batch; ``rows`` is the slice of the batch."""
    for batch in batches:
        for lo, hi, buf, offsets in chunks(batch.column(text)):
            got = kernel(batch.slice(lo, hi - lo), buf, offsets)
            for part in got if isinstance(got, list) else [got]:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (part[f.name] for f in schema)], schema=schema) if part else pa.RecordBatch.from_pylist([], schema=schema)


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in ``table`` inside each document, and per document the range of its runs."""
    n = int(offsets[-1])
    member = np.zeros(n + 1, bool)
    member[:n] = table[buf[:n]]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = member[first]
    finishes = np.zeros(n + 1, bool)  # at the byte after a run
    finishes[1:] = member[:-1] & ~member[1:]
    last = offsets[1:][offsets[1:] > 0]
    finishes[last] = member[last - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
    return starts, ends, np.searchsorted(starts, offsets)


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """The document of each run, from the ranges that ``spans`` gives."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the ranges ``bounds``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def words_at(buf: np.ndarray, dtype: str) -> np.ndarray:
    """``buf`` read as little-endian integers that begin at every byte."""
    size = np.dtype(dtype).itemsize
    return np.ndarray((len(buf) - size + 1,), dtype, buf, 0, (1,))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; wraps silently."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time for all spans together."""
    length = ends - starts
    lanes = words_at(buf, "<u8")
    h = mix(length.astype(np.uint64) * _M1 + np.uint64(seed))
    take = np.minimum(length, 8)
    if len(starts):
        h = mix(h ^ ((lanes[starts] & _MASK[take]) * _M1))
    todo = np.flatnonzero((length > 8) & (length <= LONG_SPAN))
    at = 8
    while len(todo):
        rest = length[todo] - at
        v = lanes[starts[todo] + at] & _MASK[np.minimum(rest, 8)]
        h[todo] = mix(h[todo] ^ (v * _M1))
        at += 8
        todo = todo[rest > 8]
    for k in np.flatnonzero(length > LONG_SPAN):
        d = hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, salt=int(seed).to_bytes(16, "little")).digest()
        h[k] = np.frombuffer(d, "<u8")[0]
    return h


def combine(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """Order-sensitive 64-bit hash of parallel arrays of hashes."""
    h = np.full(len(parts[0]), (seed * 0x9E3779B97F4A7C15 + len(parts)) & (1 << 64) - 1, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(5) + p + _M1)
    return h


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive entries by doubling; entry i covers i to i + size - 1 and is meaningless if that leaves the array."""
    if not len(h):
        return h.copy()
    out, covered, block, width = None, 0, mix(h ^ np.uint64(seed)), 1
    left = size
    while left:
        if left & 1:
            part = np.roll(block, -covered)
            out = part if out is None else mix(out * np.uint64(5) + part + np.uint64(width))
            covered += width
        left >>= 1
        if left:
            block = mix(block * np.uint64(3) + np.roll(block, -width) + np.uint64(width))
            width *= 2
    return out


def window_mask(bounds: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of ``size`` runs that begins at a run stays in its document."""
    n = int(bounds[-1])
    last = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + size <= last


def covered(marks: np.ndarray, size: int) -> np.ndarray:
    """Entries inside a window of ``size`` entries that begins at a marked entry."""
    d = np.zeros(len(marks) + size + 1, np.int32)
    at = np.flatnonzero(marks)
    d[at] += 1
    d[at + size] -= 1
    return np.cumsum(d)[: len(marks)] > 0


def repeated_in_doc(keys: np.ndarray, docs: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Entries whose key is found more than once in their document (``later_only``: not the first)."""
    salted = mix(keys + (docs.astype(np.uint64) + np.uint64(1)) * _M2)
    order = np.argsort(salted, kind="stable")
    s = salted[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    if not later_only and len(s):
        same[:-1] |= same[1:]
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of byte spans, computed for all spans together by the published algorithm."""
    import xxhash

    length = (ends - starts).astype(np.int64)
    lanes, halves = words_at(buf, "<u8"), words_at(buf, "<u4")
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + _P5, np.uint64)
        pos = starts.astype(np.int64).copy()
        big = np.flatnonzero((length >= 32) & (length <= LONG_SPAN))
        if len(big):
            acc = [np.full(len(big), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            live, at = np.arange(len(big)), starts[big].astype(np.int64).copy()
            while len(live):
                for k in range(4):
                    acc[k][live] = _rotl(acc[k][live] + lanes[at[live] + 8 * k] * _P2, 31) * _P1
                at[live] += 32
                live = live[ends[big[live]] - at[live] >= 32]
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ (_rotl(a * _P2, 31) * _P1)) * _P1 + _P4
            h[big], pos[big] = x, at
        h += length.astype(np.uint64)
        todo = np.flatnonzero((ends - pos >= 8) & (length <= LONG_SPAN))
        while len(todo):
            k = _rotl(lanes[pos[todo]] * _P2, 31) * _P1
            h[todo] = _rotl(h[todo] ^ k, 27) * _P1 + _P4
            pos[todo] += 8
            todo = todo[ends[todo] - pos[todo] >= 8]
        todo = np.flatnonzero((ends - pos >= 4) & (length <= LONG_SPAN))
        h[todo] = _rotl(h[todo] ^ (halves[pos[todo]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[todo] += 4
        todo = np.flatnonzero((ends > pos) & (length <= LONG_SPAN))
        while len(todo):
            h[todo] = _rotl(h[todo] ^ (buf[pos[todo]].astype(np.uint64) * _P5), 11) * _P1
            pos[todo] += 1
            todo = todo[ends[todo] > pos[todo]]
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(length > LONG_SPAN):
        h[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed)
    return h


class Lookup:
    """Places of distinct 64-bit keys in the given order: one table access for most, a bisection where keys share a slot."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        bits = int(np.clip(np.ceil(np.log2(8 * len(keys) + 1)), 10, 23))
        self.shift = np.uint64(64 - bits)
        slot = (mix(self.keys) >> self.shift).astype(np.int64)
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        self.table[slot[np.bincount(slot, minlength=1 << bits)[slot] > 1]] = -2

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for others."""
        got = self.table[(mix(keys) >> self.shift).astype(np.int64)]
        many = np.flatnonzero(got == -2)
        if len(many):
            got[many] = np.minimum(np.searchsorted(self.keys, keys[many]), len(self.keys) - 1)
        some = np.flatnonzero(got >= 0)
        place = got[some]
        got[some] = np.where(self.keys[place] == keys[some], self.order[place], -1)
        return got
