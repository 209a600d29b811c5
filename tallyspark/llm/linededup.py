"""Corpus-wide line deduplication with a sharded minimal perfect hash.

1.  Every long enough line becomes a pair of 64-bit hashes; counts and the
    largest document of each are aggregated with map-side combine.
2.  The hashes that reach the threshold are sharded by their top bits.  Each
    shard gets a minimal perfect hash (a cascade of bit arrays; the index is a
    rank) over three arrays: fingerprint, count and keeper.
3.  Documents probe the arrays.  If all shards together are below
    ``broadcast_limit`` bytes they are broadcast and no line leaves its document;
    beyond it the probes are routed to their shards, salted by shard weight.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .runtime import durable, parallelism

_NEWLINE = A._ALL != 0x0A
_LEAD = (A._ALL & 0xC0) != 0x80
#: A null id as a keeper: below all others.
NO_ID = -(1 << 63)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: level by level, keys that are alone in their slot stay, the others go on."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base, seed = 0, 0
        while len(keys):
            slots = max(64, -(-int(gamma * len(keys)) // 64) * 64)
            at = self._slot(keys, seed, slots)
            single = np.bincount(at, minlength=slots) == 1
            words = np.packbits(single, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            self.levels.append((slots, words, ranks))
            base += int(single.sum())
            keys = keys[~single[at]]
            seed += 1
            if seed > 200:
                raise ValueError("keys are not distinct")
        self.size = base

    @staticmethod
    def _slot(keys: np.ndarray, seed: int, slots: int) -> np.ndarray:
        return (A.mix(keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(slots)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key that was built in; anything, or -1, for others."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for seed, (slots, words, ranks) in enumerate(self.levels):
            at = self._slot(keys[todo], seed, slots)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (ranks[at >> 6] + below)[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class LineShard:
    """Arrays behind a perfect hash: fingerprint, count and keeper of each line of a shard."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        self.hash = PerfectHash(h1)
        at = self.hash.index(h1)
        self.fingerprint, self.count, self.keeper = np.empty(len(at), np.uint64), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        self.fingerprint[at], self.count[at], self.keeper[at] = h2, count, keeper

    def probe(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether each line is to go from the document with its id."""
        at = self.hash.index(h1)
        known = np.flatnonzero(at >= 0)
        out = np.zeros(len(h1), bool)
        a = at[known]
        out[known] = (self.fingerprint[a] == h2[known]) & (self.count[a] >= min_docs) & (self.keeper[a] != ids[known])
        return out


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ranges per document of \\n-split lines; an empty text has one empty line."""
    n = int(offsets[-1])
    breaks = np.flatnonzero(buf[:n] == 0x0A)
    doc = np.searchsorted(offsets, breaks, side="right") - 1
    n_lines = np.bincount(doc, minlength=len(offsets) - 1) + 1
    bounds = np.concatenate([[0], np.cumsum(n_lines)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    starts[bounds[:-1]], ends[bounds[1:] - 1] = offsets[:-1], offsets[1:]
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = False
    starts[inner] = breaks + 1
    inner[:] = True
    inner[bounds[1:] - 1] = False
    ends[inner] = breaks
    return starts, ends, bounds


def line_keys(buf: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Line spans, and the indices and two hashes of lines whose stripped, lower-cased key has ``min_chars`` code points."""
    starts, ends, bounds = line_spans(buf, offsets)
    n = int(offsets[-1])
    word = np.flatnonzero(A.IS_WORD[buf[:n]])
    lo = np.searchsorted(word, starts)
    hi = np.searchsorted(word, ends)
    some = hi > lo
    s, e = starts.copy(), starts.copy()
    s[some], e[some] = word[lo[some]], word[hi[some] - 1] + 1
    lead = np.zeros(n + 1, np.int64)
    np.cumsum(_LEAD[buf[:n]], out=lead[1:])
    long = np.flatnonzero(lead[e] - lead[s] >= min_chars)
    low = A.LOWER[buf]
    h1, h2 = A.hash_spans(low, s[long], e[long], 1), A.hash_spans(low, s[long], e[long], 2)
    return starts, ends, bounds, long, h1, h2


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _count_kernel(rows, buf, offsets, min_chars):
    _, _, bounds, at, h1, h2 = line_keys(buf, offsets, min_chars)
    doc = A.doc_of(bounds)[at]
    first = ~A.repeated_in_doc(A.combine([h1, h2]), doc, later_only=True)
    return {"h1": h1[first].view(np.int64), "h2": h2[first].view(np.int64), "id": _ids(rows)[doc[first]]}


def _count_batches(batches, min_chars):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64())])
    return A.map_chunks(batches, "text", partial(_count_kernel, min_chars=min_chars), schema)


def _build_shard(table: pa.Table) -> pa.Table:
    h1, h2 = table["h1"].to_numpy().view(np.uint64), table["h2"].to_numpy().view(np.uint64)
    # Two lines with one h1 differ in h2: all but one of them go to the next array, built over h2 in its place.
    count, keeper = table["n"].to_numpy(), table["keeper"].to_numpy()
    arrays, rest = [], np.arange(len(h1))
    while len(rest):
        _, first = np.unique(h1[rest], return_index=True)
        now = rest[first]
        arrays.append(LineShard(h1[now], h2[now], count[now], keeper[now]))
        rest = np.setdiff1d(rest, now)
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps(arrays)], pa.binary()), "weight": pa.array([int(count.sum())], pa.int64())})


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1 << 17) -> DataFrame:
    """``(shard, blob, weight, bits)``: the shards of the perfect hash over all lines of ``min_chars`` code points in ``min_docs`` documents.

    Every row counts as a document.  Lines below the threshold stay out: a
    probe that finds nothing keeps its line, which is their answer as well.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = rows.mapInArrow(partial(_count_batches, min_chars=min_chars), "h1 long, h2 long, id long")
    frequent = durable(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs))
    bits = max(0, int(np.ceil(np.log2(max(1, frequent.count() / shard_keys)))))
    shard = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
    built = frequent.withColumn("shard", shard).groupBy("shard").applyInArrow(_build_shard, "shard long, blob binary, weight long")
    return durable(built.withColumn("bits", F.lit(bits)))


def _probe(shards: dict[int, list[LineShard]], bits: int, h1, h2, ids, min_docs) -> np.ndarray:
    out = np.zeros(len(h1), bool)
    shard = h1 >> np.uint64(64 - bits) if bits else np.zeros(len(h1), np.uint64)
    for k in np.unique(shard):
        at = np.flatnonzero(shard == k)
        for arrays in shards.get(int(k), []):
            out[at] |= arrays.probe(h1[at], h2[at], ids[at], min_docs)
    return out


def _rewrite(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, starts, ends, bounds, drop: np.ndarray) -> dict:
    """The columns of the result: texts without the dropped lines."""
    n_lines, n_dropped = np.diff(bounds), A.per_doc(drop, bounds)
    raw = buf[: int(offsets[-1])].tobytes()
    texts = []
    for d in range(len(bounds) - 1):
        if not n_dropped[d]:
            texts.append(raw[offsets[d] : offsets[d + 1]])
        else:
            texts.append(b"\n".join(raw[starts[k] : ends[k]] for k in range(bounds[d], bounds[d + 1]) if not drop[k]))
    return {"id": rows.column(0), "n_lines": n_lines, "n_dropped": n_dropped, "kept": pa.array(texts, pa.binary()).cast(pa.string()), "rest": rows.column(2)}


_OUT = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def _schema(batch_schema: pa.Schema) -> pa.Schema:
    return _OUT.append(pa.field("rest", batch_schema.field(2).type))


def _apply_broadcast(batches: Iterator[pa.RecordBatch], shards, bits, min_chars, min_docs):
    loaded = {k: pickle.loads(v) for k, v in shards.value.items()}

    def kernel(rows, buf, offsets):
        starts, ends, bounds, at, h1, h2 = line_keys(buf, offsets, min_chars)
        drop = np.zeros(len(starts), bool)
        drop[at] = _probe(loaded, bits, h1, h2, _ids(rows)[A.doc_of(bounds)[at]], min_docs)
        return _rewrite(rows, buf, offsets, starts, ends, bounds, drop)

    for batch in batches:
        yield from A.map_chunks([batch], "text", kernel, _schema(batch.schema))


def _route_batches(batches, min_chars, bits):
    schema = pa.schema([("shard", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("print", pa.int64()), ("line", pa.int64())])

    def kernel(rows, buf, offsets):
        starts, _, bounds, at, h1, h2 = line_keys(buf, offsets, min_chars)
        doc = A.doc_of(bounds)[at]
        prints = A.hash_spans(buf, offsets[:-1], offsets[1:], 7)
        shard = h1 >> np.uint64(64 - bits) if bits else np.zeros(len(h1), np.uint64)
        return {"shard": shard.view(np.int64), "h1": h1.view(np.int64), "h2": h2.view(np.int64), "id": _ids(rows)[doc], "print": prints[doc].view(np.int64), "line": at - bounds[doc]}

    return A.map_chunks(batches, "text", kernel, schema)


def _print_batches(batches):
    for batch in batches:
        prints = [A.hash_spans(buf, off[:-1], off[1:], 7).view(np.int64) for _, _, buf, off in A.chunks(batch.column("text"))]
        yield batch.append_column("print", pa.array(np.concatenate(prints) if prints else np.zeros(0, np.int64)))


def _answer(probes: pa.Table, shard: pa.Table, min_docs: int) -> pa.Table:
    if shard.num_rows and probes.num_rows:
        arrays = pickle.loads(shard["blob"][0].as_py())
        h1, h2, ids = (probes[c].to_numpy() for c in ("h1", "h2", "id"))
        drop = np.zeros(len(h1), bool)
        for a in arrays:
            drop |= a.probe(h1.view(np.uint64), h2.view(np.uint64), ids, min_docs)
        return probes.filter(pa.array(drop)).select(["id", "print", "line"])
    return probes.slice(0, 0).select(["id", "print", "line"]) if probes.num_columns else pa.table({c: pa.array([], pa.int64()) for c in ("id", "print", "line")})


def _apply_routed(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for lo, hi, buf, offsets in A.chunks(batch.column("text")):
            rows = batch.slice(lo, hi - lo)
            starts, ends, bounds = line_spans(buf, offsets)
            lists = rows.column(3).fill_null([]) if rows.column(3).null_count else rows.column(3)
            drop = np.zeros(len(starts), bool)
            owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
            drop[bounds[owner] + lists.flatten().to_numpy(zero_copy_only=False)] = True
            got = _rewrite(rows, buf, offsets, starts, ends, bounds, drop)
            schema = _schema(batch.schema)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (got[f.name] for f in schema)], schema=schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_limit: int = 64 << 20, probes_per_task: int = 500_000) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` rewritten, plus ``n_lines`` and ``n_dropped`` (named so even where ``docs`` has such columns: those are replaced).

    A line's key is the line stripped of white space with A-Z lower-cased.
    Keys of ``min_chars`` code points in ``min_docs`` rows lose all their lines
    but those of the rows with the largest id.  A null text is one empty line
    and becomes empty; a null id is below all ids; repeated rows are separate
    documents that share their fate.
    """
    spark = docs.sparkSession
    index = line_index(docs, id_col, text_col, min_chars, min_docs)
    total = index.agg(F.sum(F.length("blob")).alias("bytes"), F.max("bits").alias("bits")).first()
    bits = total["bits"] or 0
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()), packed.schema["rest"]])
    if (total["bytes"] or 0) <= broadcast_limit:
        shards = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.select("shard", "blob").collect()})
        done = packed.mapInArrow(partial(_apply_broadcast, shards=shards, bits=bits, min_chars=min_chars, min_docs=min_docs), out)
    else:
        done = _routed(packed, index, bits, min_chars, min_docs, probes_per_task, out)
    return done.select(F.col("id").alias(id_col), F.col("kept").alias(text_col), *[F.col("rest")[c].alias(c) for c in others], "n_lines", "n_dropped")


def _routed(packed: DataFrame, index: DataFrame, bits: int, min_chars: int, min_docs: int, probes_per_task: int, out: T.StructType) -> DataFrame:
    salts = F.greatest(F.lit(1), F.ceil(F.col("weight") / probes_per_task)).cast("int")
    sized = index.select("shard", salts.alias("salts"))
    probes = (
        packed.select("id", "text").mapInArrow(partial(_route_batches, min_chars=min_chars, bits=bits), "shard long, h1 long, h2 long, id long, print long, line long")
        .join(sized, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "print", "line"), F.col("salts")).cast("int")).drop("salts")
    )
    shards = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("shard", "salt", "blob")
    answers = probes.groupBy("shard", "salt").cogroup(shards.groupBy("shard", "salt")).applyInArrow(partial(_answer_group, min_docs=min_docs), "id long, print long, line long")
    lines = answers.distinct().groupBy("id", "print").agg(F.collect_list("line").alias("lines"))
    marked = packed.mapInArrow(_print_batches, T.StructType([*packed.schema.fields, T.StructField("print", T.LongType())])).withColumn("key", F.coalesce("id", F.lit(NO_ID)))
    return marked.join(lines.withColumnRenamed("id", "key"), ["key", "print"], "left").select("id", "text", "rest", "lines").mapInArrow(_apply_routed, out)


def _answer_group(left: pa.Table, right: pa.Table, min_docs: int) -> pa.Table:
    return _answer(left, right, min_docs)
