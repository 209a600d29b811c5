"""Exact removal of long repeated passages by recompression.

Words are named by hashes and texts are compressed in rounds, as in
recompression: a round names the pairs (a, b) whose left symbol falls into the
left half and whose right symbol into the right half of that round's split of
all symbols; runs of one symbol are named before.  Names and splits only depend
on content, so equal passages get equal symbols inside, whatever stands around
them, and no round needs the corpus.  Each symbol knows the words it depends on.

A window of words is known by the longest symbol it owns, that is, one that
depends on words of the window alone.  Equal windows are known by equal names.

Names only bring together what may be equal.  What is equal is decided on the
words themselves, by a 128-bit BLAKE2b digest of their bytes with one space behind each:
words, pairs or windows whose names collide, by chance or by design, repeat nothing.

1.  Neighbouring windows known by one symbol are a block. Blocks are dealt out
    by name.  A name found once has no repeated window; a block whose whole
    content is found again is repeated as a whole; only where blocks of one
    name differ, their windows have to be compared one by one, a single
    representative of each block being enough.
2.  Those windows, and the few that own no symbol, are dealt out by 64 bits of
    a hash and compared by their digests.

Rows that are alike in a slice of a task are combined before they are shuffled,
so a passage of a third of all documents costs one row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as A
from .runtime import durable_alone

ROUNDS = 6
#: Null ids, for grouping.
NO_ID = -(1 << 63)
_BLOCK, _WINDOW, _KNOWN = 0, 1, 2
_REPEATED, _COMPARE, _WITNESS = 1, 2, 3
_ROWS = [("name", pa.int64()), ("content", pa.int64()), ("content2", pa.int64()), ("kind", pa.int32()), ("weight", pa.int32()), ("id", pa.int64()), ("print", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
_ROWS_SQL = "name long, content long, content2 long, kind int, weight int, id long, print long, first int, last int"


def recompress(words: np.ndarray, bounds: np.ndarray, rounds: int):
    """Symbols after ``rounds`` rounds: names, documents, and the range of words each depends on.

    A range that leaves its document (below its first or beyond its last word)
    belongs to a symbol whose shape depends on the text's edge.
    """
    doc = A.doc_of(bounds)
    n = len(words)
    sym, at = words, np.arange(n)  # names, and the first word of each symbol
    lo, hi = at, at + 1
    beyond = 1 << 60
    for r in range(rounds):
        if not len(sym):
            break
        # A symbol is no part of a run if its neighbours differ. The word beside it tells, unless it is the one that an
        # equal neighbour would show there: then all that the neighbour depends on counts.
        end = np.r_[at[1:], n]
        opens, closes = at == bounds[doc], end == bounds[doc + 1]
        left_word, right_word = words[np.maximum(at - 1, 0)], words[np.minimum(end, n - 1)]
        lo_before, hi_after = np.r_[-1, lo[:-1]], np.r_[hi[1:], beyond]
        lo = np.minimum(lo, np.where(opens, -1, np.where(left_word != words[end - 1], at - 1, lo_before)))
        hi = np.maximum(hi, np.where(closes, beyond, np.where(right_word != words[at], end + 1, hi_after)))
        # runs of one symbol get one name
        starts = np.r_[True, (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(starts)
        if len(first) < len(sym):
            size = np.diff(np.r_[first, len(sym)])
            s = sym[first]
            s = np.where(size > 1, A.mix(s * np.uint64(7) + size.astype(np.uint64) + np.uint64(r)), s)
            sym, doc, at, lo, hi = s, doc[first], at[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        # pairs from the left half of the symbols to the right half
        left = (A.mix(sym + np.uint64((2 * r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63)) == 0
        same = np.r_[doc[1:] == doc[:-1], False]
        joins = np.zeros(len(sym), bool)
        joins[:-1] = left[:-1] & ~left[1:] & same[:-1]
        # every symbol looks at one neighbour: a left one at the next, a right one at the one before
        edge_next, edge_before = ~same, np.r_[True, ~same[:-1]]
        see_hi = np.where(left, np.where(edge_next, beyond, np.r_[hi[1:], 0]), hi)
        see_lo = np.where(~left, np.where(edge_before, -1, np.r_[0, lo[:-1]]), lo)
        hi, lo = np.maximum(hi, see_hi), np.minimum(lo, see_lo)
        head = np.flatnonzero(joins)
        keep = np.ones(len(sym), bool)
        keep[head + 1] = False
        sym = sym.copy()
        sym[head] = A.combine([sym[head], sym[head + 1]], 100 + r)
        lo[head], hi[head] = np.minimum(lo[head], lo[head + 1]), np.maximum(hi[head], hi[head + 1])
        sym, doc, at, lo, hi = sym[keep], doc[keep], at[keep], lo[keep], hi[keep]
    return sym, doc, lo, hi


def designate(sym: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """For the window that begins at each word, the symbol it is known by: of those it owns the longest, by name among equals; -1 without any.

    The choice only depends on the window's own words.  Entries where no window
    fits into the document are meaningless.
    """
    n = int(bounds[-1])
    out = np.full(n, -1, np.int64)
    own = np.flatnonzero((lo >= bounds[doc]) & (hi <= bounds[doc + 1]) & (hi - lo <= window))
    if not len(own):
        return out
    lo, hi = lo[own], hi[own]
    # rank: smaller is better; a permutation, so that minima are places
    order = np.lexsort((sym[own], -(np.minimum(hi - lo, 24) // 4)))
    key = np.empty(len(own), np.int64)
    # equal symbols of equal length share a rank, the leftmost of them wins
    s, z = sym[own][order], (np.minimum(hi - lo, 24) // 4)[order]
    key[order] = np.cumsum(np.r_[0, (s[1:] != s[:-1]) | (z[1:] != z[:-1])]) * 1
    key = key * len(own) + np.arange(len(own))
    at = np.arange(n)
    low_sorted = np.maximum.accumulate(lo)  # symbols are in order; their ranges nearly are
    high_sorted = np.minimum.accumulate(hi[::-1])[::-1]
    p = np.searchsorted(low_sorted, at, side="left")
    q = np.searchsorted(high_sorted, at + window, side="right")
    some = np.flatnonzero(q > p)
    p, q = p[some], q[some]
    width = q - p
    level = np.frexp(width.astype(float))[1] - 1
    best = np.full(len(some), np.iinfo(np.int64).max)
    table, k = key, 0
    while True:
        here = np.flatnonzero(level == k)
        if len(here):
            best[here] = np.minimum(table[p[here]], table[q[here] - (1 << k)])
        k += 1
        if k > int(level.max(initial=0)) or len(table) <= 1 << (k - 1):
            break
        table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
    out[some] = own[best % len(own)]
    return out


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the digest of each range of words, ``first`` to ``last``, with one space behind every word."""
    if not len(first):
        return np.zeros((0, 2), np.uint64)
    size = ends - starts + 1
    places = np.concatenate([[0], np.cumsum(size)])
    plain = np.full(int(places[-1]), 0x20, np.uint8)
    inside = np.ones(len(plain), bool)
    inside[places[1:] - 1] = False
    n = int(ends[-1])
    member = np.zeros(n + 1, np.int8)
    np.add.at(member, starts, 1)
    np.add.at(member, ends, -1)
    plain[inside] = buf[:n][np.cumsum(member, dtype=np.int8)[:n] > 0]
    raw = memoryview(plain.tobytes())
    told = [blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(places[first].tolist(), places[last + 1].tolist())]
    return np.frombuffer(b"".join(told), "<u8").reshape(-1, 2)


def _combined(rows: pa.RecordBatch, bounds: np.ndarray, name, content, kind, weight, first, last) -> dict:
    """Rows of a slice to be dealt out: one for each (name, content), and ranges of windows already seen twice here."""
    doc = np.searchsorted(bounds, first, side="right") - 1
    order = np.argsort(A.combine([name, content[:, 0], kind.astype(np.uint64)]), kind="stable")
    # rows whose keys collide are only combined less
    differ = lambda x: x[order][1:] != x[order][:-1]
    begins = np.r_[True, differ(name) | differ(content[:, 0]) | differ(content[:, 1]) | differ(kind)] if len(name) else np.zeros(0, bool)
    at, group = order[begins], np.empty(len(name), np.int64)
    group[order] = np.cumsum(begins) - 1
    total = np.bincount(group, weights=weight, minlength=len(at)).astype(np.int64)
    twice = np.flatnonzero(total[group] > 1)
    marks = np.zeros(int(bounds[-1]) + 1, np.int32)
    np.add.at(marks, first[twice], 1)
    np.add.at(marks, last[twice] + 1, -1)
    seen = np.cumsum(marks)[:-1] > 0
    where = np.flatnonzero(seen)
    owner = np.searchsorted(bounds, where, side="right") - 1
    begin = np.flatnonzero(np.r_[True, (where[1:] != where[:-1] + 1) | (owner[1:] != owner[:-1])]) if len(where) else where
    known_first, known_doc = where[begin], owner[begin]
    known_last = where[np.r_[begin[1:], len(where)] - 1] if len(where) else where
    ids, prints = rows.column("id").to_numpy(), rows.column("print").to_numpy()
    d = np.r_[doc[at], known_doc]
    return {
        "name": np.r_[name[at], A.mix(known_first.astype(np.uint64) + prints[known_doc].view(np.uint64))].view(np.int64), **{c: np.r_[content[at, k], np.zeros(len(begin), np.uint64)].view(np.int64) for k, c in enumerate(("content", "content2"))},
        "kind": np.r_[kind[at], np.full(len(begin), _KNOWN)].astype(np.int32), "weight": np.r_[np.minimum(total, 2), np.full(len(begin), 2)].astype(np.int32), "id": ids[d], "print": prints[d],
        "first": (np.r_[first[at], known_first] - bounds[d]).astype(np.int32), "last": (np.r_[last[at], known_last] - bounds[d]).astype(np.int32),
    }


def _block_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, window: int) -> dict:
    starts, ends, bounds = A.spans(buf, offsets, A.IS_WORD)
    words = A.hash_spans(buf, starts, ends)
    whole = A.windows(words, window)
    fits = A.window_mask(bounds, window)
    sym, doc, lo, hi = recompress(words, bounds, ROUNDS)
    known_by = designate(sym, doc, lo, hi, bounds, window)
    at = np.flatnonzero(fits & (known_by >= 0))
    by = known_by[at]
    begin = np.flatnonzero(np.r_[True, (by[1:] != by[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else at
    first, last = at[begin], at[np.r_[begin[1:], len(at)] - 1] if len(at) else at
    alone = np.flatnonzero(fits & (known_by < 0))
    n = len(first)
    content = digests(buf, starts, ends, np.r_[first, alone], np.r_[last, alone] + window - 1)
    return _combined(
        rows, bounds, np.r_[sym[by[begin]] if n else whole[:0], whole[alone]], content, np.r_[np.full(n, _BLOCK), np.full(len(alone), _WINDOW)],
        np.ones(n + len(alone)), np.r_[first, alone], np.r_[last, alone],
    )


def _block_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    return A.map_chunks(batches, "text", partial(_block_kernel, window=window), pa.schema(_ROWS))


def _unpack(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first, last and status of packed ranges."""
    if lists.null_count:
        lists = lists.fill_null([])
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    v = lists.flatten().to_numpy(zero_copy_only=False)
    first = v >> 32
    return row, first, first + ((v & 0xFFFFFFFF) >> 2), v & 3


def _window_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, window: int) -> dict:
    row, first, last, status = _unpack(rows.column("ranges"))
    ask = status >= _COMPARE
    row, first, last, status = row[ask], first[ask], last[ask], status[ask]
    starts, ends, bounds = A.spans(buf, offsets, A.IS_WORD)
    words = A.hash_spans(buf, starts, ends)
    one = A.windows(words, window)
    size = last - first + 1
    at = np.repeat(bounds[row] + first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    weight = np.repeat(np.where(status == _WITNESS, 2, 1), size)
    return _combined(rows, bounds, one[at], digests(buf, starts, ends, at, at + window - 1), np.full(len(at), _WINDOW), weight, at, at)


def _window_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    return A.map_chunks(batches, "text", partial(_window_kernel, window=window), pa.schema(_ROWS))


def _remove_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, window: int) -> dict:
    starts, ends, bounds = A.spans(buf, offsets, A.IS_WORD)
    n_docs, n_words = len(bounds) - 1, len(starts)
    gone = np.zeros(n_words + 1, np.int32)
    for column in ("ranges", "more"):
        row, first, last, status = _unpack(rows.column(column))
        yes = status != _COMPARE
        np.add.at(gone, bounds[row[yes]] + first[yes], 1)
        np.add.at(gone, bounds[row[yes]] + last[yes] + window, -1)
    drop = np.cumsum(gone)[:-1] > 0
    doc = A.doc_of(bounds)
    kept = np.flatnonzero(~drop)
    final = np.r_[doc[kept][1:] != doc[kept][:-1], True] if len(kept) else np.zeros(0, bool)
    size = ends[kept] - starts[kept] + ~final  # a space after all but the last
    n = int(offsets[-1])
    inside = np.zeros(n + 2, np.int8)
    np.add.at(inside, starts[kept], 1)
    np.add.at(inside, ends[kept] + ~final, -1)
    keep = np.cumsum(inside, dtype=np.int8)[:n] > 0
    text = buf[:n][keep]
    text = np.where(A.IS_WORD[text], text, 0x20).astype(np.uint8)
    length = np.bincount(doc[kept], weights=size, minlength=n_docs).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    texts = pa.StringArray.from_buffers(n_docs, pa.py_buffer(place), pa.py_buffer(text))
    ids = rows.column("id").to_numpy()
    return {"id": pa.array(ids, mask=ids == NO_ID), "text": texts, "n_words": np.diff(bounds), "n_removed": A.per_doc(drop, bounds)}


def _remove_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
    return A.map_chunks(batches, "text", partial(_remove_kernel, window=window), schema)


def _ranges(dealt: DataFrame, name: str) -> DataFrame:
    """Per row the ranges that are repeated or have to be compared window by window.

    One shuffle and one sort by name; a name's rows are never gathered in memory,
    since windows spill.
    """
    same = Window.partitionBy("name", "kind", "content", "content2").orderBy("id", "print", "first")
    block = dealt.repartition("name").select(
        "*", F.row_number().over(same).alias("nth"), F.sum("weight").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")
    )
    alike = Window.partitionBy("name", "kind")
    judged = block.withColumn("differ", (F.min("content").over(alike) != F.max("content").over(alike)) | (F.min("content2").over(alike) != F.max("content2").over(alike)))
    repeated = (F.col("total") > 1) | (F.col("kind") == _KNOWN)
    mixed = (F.col("kind") == _BLOCK) & F.col("differ") & (F.col("nth") == 1)
    status = F.when(mixed, F.when(repeated, _WITNESS).otherwise(_COMPARE)).when(repeated, _REPEATED).otherwise(0)
    packed = F.shiftleft(F.col("first").cast("long"), 32) + F.shiftleft((F.col("last") - F.col("first")).cast("long"), 2) + status
    told = judged.where(status > 0).select("id", "print", packed.alias("range"))
    return told.groupBy("id", "print").agg(F.collect_list("range").alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``(id, text, n_words, n_removed)`` per row, ``text`` the kept words joined by one space.

    A word goes if some run of ``window`` words that covers it starts anywhere
    else too, be it in the same document.  Words are runs of non-white-space,
    unchanged.  Null, empty and blank texts become empty; texts shorter than a
    window are kept whole; repeated rows repeat each other's windows, also under
    one id; a null id is an id like others.
    """
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumn("print", F.xxhash64("text"))
    ranges = durable_alone(_ranges(keyed.mapInArrow(partial(_block_batches, window=window), _ROWS_SQL), "ranges"))
    told = keyed.join(ranges, ["id", "print"], "left")
    more = _ranges(told.mapInArrow(partial(_window_batches, window=window), _ROWS_SQL), "more")
    done = told.join(more, ["id", "print"], "left").select("id", "text", "ranges", "more")
    return done.mapInArrow(partial(_remove_batches, window=window), "id long, text string, n_words long, n_removed long")
