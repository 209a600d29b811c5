"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items.  Texts become arrays
of vocabulary numbers (0 for a word that no item has).  A shift table over
blocks of two words tells how far the search may jump ahead; where it says zero,
a bucket chosen by a hash of the suffix block and the prefix gives the pattern
to compare with, number by number and byte by byte.  All documents of a batch
are searched side by side, one lane each (long ones have several).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .runtime import stored

#: Words that one lane searches.
LANE = 2048
_EMPTY = np.zeros(0, np.int64)


def _words(buf: np.ndarray, offsets: np.ndarray):
    """The lower-cased buffer, and spans and hashes of its words."""
    low = A.LOWER[buf]
    starts, ends, bounds = A.spans(low, offsets, A.IS_ALNUM)
    return low, starts, ends, bounds, A.hash_spans(low, starts, ends)


def equal_spans(a: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """Whether byte spans of two padded buffers are equal, pair by pair."""
    length = a_hi - a_lo
    same = length == b_hi - b_lo
    wide_a, wide_b = A.words_at(a, "<u8"), A.words_at(b, "<u8")
    at, todo = 0, np.flatnonzero(same)
    while len(todo):
        mask = A._MASK[np.minimum(length[todo] - at, 8)]
        equal = (wide_a[a_lo[todo] + at] & mask) == (wide_b[b_lo[todo] + at] & mask)
        same[todo[~equal]] = False
        at += 8
        todo = todo[equal & (length[todo] > at)]
    return same


class _Class:
    """Tables for the patterns of one length."""

    def __init__(self, patterns: np.ndarray, owner: np.ndarray):
        self.patterns, self.owner = patterns, owner  # rows of word numbers; index among all patterns
        n, self.length = patterns.shape
        self.block = min(2, self.length)
        self.mask = (1 << max(10, min(22, math.ceil(math.log2(8 * n * self.length + 1))))) - 1
        reach = self.length - self.block
        self.shift = np.full(self.mask + 1, reach + 1, np.int16)
        for j in range(reach + 1):
            np.minimum.at(self.shift, self.slots(patterns[:, j], patterns[:, j + self.block - 1]), reach - j)
        keys = self.keys(patterns)
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.order = keys[order], order

    def slots(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (first.astype(np.int64) * 40503 + last.astype(np.int64) * 2654435761) & self.mask

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Bucket of a pattern: hash of its suffix block and of the words before."""
        return A.combine([rows[:, k].astype(np.uint64) for k in range(rows.shape[1] - 1, -1, -1)])

    def search(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences, and their patterns; every pattern is distinct, so a place has one at most."""
        size = np.maximum(np.diff(bounds) - self.length + 1, 0)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(len(size)), lanes)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = bounds[:-1][doc] + part * LANE + self.length - 1  # where a window ends
        stop = np.minimum(at + LANE, bounds[1:][doc])
        found = []
        while len(at):
            last = ids[at]
            step = self.shift[self.slots(ids[at - self.block + 1], last)].astype(np.int64)
            step[last == 0] = self.length
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                step[hit] = 1
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return _EMPTY, _EMPTY
        ends = np.concatenate(found)
        rows = ids[(ends - self.length + 1)[:, None] + np.arange(self.length)]
        keys = self.keys(rows)
        k = np.searchsorted(self.sorted_keys, keys)
        k[k == len(self.sorted_keys)] = 0
        pattern = self.order[k]
        same = (self.sorted_keys[k] == keys) & (self.patterns[pattern] == rows).all(axis=1)
        return (ends - self.length + 1)[same], pattern[same]


class WuManber:
    """The windows of a block of items, ready to be searched for."""

    def __init__(self, item_ids: list, texts: list[str | None], window: int):
        self.items = np.array(["" if x is None else str(x) for x in item_ids], dtype=object)
        col = pa.array(texts, pa.large_string())
        (_, _, buf, offsets), = A.chunks(col, 1 << 62) if len(col) else [(0, 0, np.zeros(A.PAD, np.uint8), np.zeros(1, np.int64))]
        low, starts, ends, bounds, hashes = _words(buf, offsets)
        self.vocab, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        ids = (ids + 1).astype(np.int32)
        self.text, self.lo, self.hi = low, starts[first], ends[first]
        bits = max(10, min(22, math.ceil(math.log2(16 * len(self.vocab) + 1))))
        self.slot_shift = np.uint64(64 - bits)
        slot = (self.vocab >> self.slot_shift).astype(np.int64)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[slot] = np.arange(1, len(slot) + 1)
        shared = np.flatnonzero(slot[1:] == slot[:-1])
        self.table[slot[shared]] = -1  # several words: looked up by bisection
        n_words = np.diff(bounds)
        self.classes, pattern_item, n_patterns = [], [], 0
        for length in sorted({min(int(x), window) for x in n_words if x}):
            at = np.flatnonzero(A.window_mask(bounds, length))
            doc = A.doc_of(bounds)[at]
            mine = n_words[doc] >= window if length == window else n_words[doc] == length
            at, doc = at[mine], doc[mine]
            distinct, number = np.unique(ids[at[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([number.ravel() + n_patterns, doc], axis=1), axis=0)
            pattern_item.append(pairs)
            self.classes.append(_Class(distinct, np.arange(len(distinct)) + n_patterns))
            n_patterns += len(distinct)
        pairs = np.concatenate(pattern_item) if pattern_item else np.zeros((0, 2), np.int64)
        self.item_of, self.first_item = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(n_patterns + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, 0 for others."""
        got = self.table[(hashes >> self.slot_shift).astype(np.int64)]
        many = np.flatnonzero(got < 0)
        if len(many):
            got[many] = np.minimum(np.searchsorted(self.vocab, hashes[many]), len(self.vocab) - 1) + 1
        some = np.flatnonzero(got)
        got[some[self.vocab[got[some] - 1] != hashes[some]]] = 0
        return got

    def search(self, buf: np.ndarray, offsets: np.ndarray):
        """Words per document, flags of hit words, their ranges, and (document, item) pairs."""
        low, starts, ends, bounds, hashes = _words(buf, offsets)
        hits = np.zeros(len(starts), bool)
        pairs = [np.zeros((0, 2), np.int64)]
        if len(starts) and len(self.vocab):
            ids = self.numbers(hashes)
            doc = A.doc_of(bounds)
            for c in self.classes:
                at, pattern = c.search(ids, bounds)
                if not len(at):
                    continue
                cells = (at[:, None] + np.arange(c.length)).ravel()
                used = np.unique(cells)
                v = ids[used] - 1
                real = np.zeros(len(starts), bool)
                real[used] = equal_spans(low, starts[used], ends[used], self.text, self.lo[v], self.hi[v])
                true = real[cells].reshape(-1, c.length).all(axis=1)
                at, pattern = at[true], c.owner[pattern[true]]
                marks = np.zeros(len(starts), bool)
                marks[at] = True
                hits |= A.covered(marks, c.length)
                count = self.first_item[pattern + 1] - self.first_item[pattern]
                which = np.repeat(self.first_item[pattern], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pairs.append(np.unique(np.stack([np.repeat(doc[at], count), self.item_of[which]], axis=1), axis=0))
        return bounds, hits, np.unique(np.concatenate(pairs), axis=0)


def _search_batches(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[pa.RecordBatch]:
    found = pickle.loads(matcher.value)
    for batch in batches:
        schema = batch.schema

        def kernel(rows, buf, offsets):
            bounds, hits, pairs = found.search(buf, offsets)
            n = len(bounds) - 1
            at = np.flatnonzero(hits)
            doc = A.doc_of(bounds)[at]
            words = np.split(at - bounds[doc], np.searchsorted(doc, np.arange(1, n))) if n else []
            items = np.split(found.items[pairs[:, 1]], np.searchsorted(pairs[:, 0], np.arange(1, n))) if n else []
            old_words, old_items = rows.column("hit_words").to_pylist(), rows.column("items").to_pylist()
            return {
                **{name: rows.column(name) for name in schema.names}, "n_words": np.diff(bounds),
                "hit_words": pa.array([np.union1d(a, b).astype(np.int32) if a else b.astype(np.int32) for a, b in zip(old_words, words)], schema.field("hit_words").type),
                "items": pa.array([sorted({*a, *b}) for a, b in zip(old_items, items)], schema.field("items").type),
            }

        yield from A.map_chunks([batch], "text", kernel, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 64 << 20) -> DataFrame:
    """Per row ``id, text, rest`` (all columns of ``docs``), ``n_words``, ``hit_words`` (indices), ``items`` (ids as sorted strings) and ``contaminated``.

    Words are runs of digits, letters and non-ASCII after A-Z were lower-cased.
    An item's windows are its runs of ``window`` words; a shorter item with any
    word is one window.  A document is contaminated if a twentieth of its words
    are hit.  Null texts have no words; an item with a null id counts as ``''``;
    repeated rows are judged alike; an empty benchmark hits nothing.  The
    benchmark is searched in blocks of ``block_bytes``, one pass over the documents each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    found = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns]).alias("rest"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in found.schema])
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        matcher = WuManber(rows["item"].to_pylist(), rows["text"].to_pylist(), window)
        tables = spark.sparkContext.broadcast(pickle.dumps(matcher))
        del matcher, rows
        found = found.mapInArrow(partial(_search_batches, matcher=tables), schema)
        if k < blocks - 1:  # a task only ever holds the tables of one block
            found = stored(found)
            tables.unpersist()
    n_hit = F.size("hit_words")
    return found.withColumn("contaminated", (n_hit > 0) & (n_hit * 20 >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    clean = contamination(docs, benchmark, id_col, text_col, **options).where("NOT contaminated")
    return clean.select(*[F.col("rest")[c].alias(c) for c in docs.columns])
