"""SimHash fingerprints and their near-duplicate groups by a binary trie self-join.

Fingerprints are joined on tries: pairs of trie nodes are walked together from
the highest bit, differing bits are added up along the way, and a pair is
dropped once it has more of them than the budget.  The tries are sharded by
the pigeonhole principle: with ``d`` allowed bits, two linked fingerprints agree
on one of ``d + 1`` blocks of bits, so each shard is the trie of the
fingerprints that share the value of one block.  Edges of the trie below which
only one fingerprint is left are compressed: a pair of such leaves adds up all
its remaining bits in one step.  Shards above ``shard_cap`` fingerprints are dealt
out as pairs of hashed parts; a task walks its shards a slice at a time and holds
``SLICE + 2 * shard_cap`` fingerprints at most.  A shard gives a spanning forest,
not all its pairs: node pairs that lie in one component already are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .components import connected_components
from .runtime import durable, parallelism, spread_join

BITS = 64
_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], dtype=np.uint64)
#: Node pairs that are expanded together.
_FRONTIER = 1 << 15
#: Fingerprints whose shards are walked together.
SLICE = 1 << 16
#: Fingerprints of a shard, or of a part of one.
SHARD_CAP = 100_000
#: Shards above this are walked at one bit first.
_LARGE = 2000


def majority_bits(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the 64 bits that are set in over half of its hashes; 0 without hashes. ``doc`` is sorted."""
    out = np.zeros(n_docs, np.uint64)
    if not len(hashes):
        return out
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    # byte-wide counters hold blocks of 255 hashes at most
    inside = np.arange(len(hashes)) - first[doc]
    begin = np.flatnonzero(inside % 255 == 0)
    owner = doc[begin]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    have = owner[edge]
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], begin).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(sums, edge, axis=0, dtype=np.int64)
        byte = np.packbits(votes * 2 > count[have][:, None], axis=1, bitorder="little")[:, 0]
        out[have] |= byte.astype(np.uint64) << np.uint64(8 * k)
    return out


def _normalised(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased words of each text joined by one space: (buffer, starts, ends, ranges per document)."""
    starts, ends, bounds = A.spans(buf, offsets, A.IS_WORD)
    n = int(offsets[-1])
    keep = A.IS_WORD[buf[: n + 1]]
    keep[n] = False
    inner = ends < n
    keep[ends[inner]] = True  # the byte after a word: white space, or the next text's first byte, kept anyway
    text = A.LOWER[buf[: n + 1]]
    text[~A.IS_WORD[text]] = 0x20
    place = np.cumsum(keep) - keep
    packed = np.zeros(int(keep.sum()) + A.PAD, np.uint8)
    packed[: len(packed) - A.PAD] = text[keep]
    return packed, place[starts], place[ends - 1] + 1 if len(ends) else ends, bounds


def _fingerprint_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> dict:
    packed, starts, ends, bounds = _normalised(buf, offsets)
    n_docs, n_words = len(bounds) - 1, np.diff(bounds)
    at = np.flatnonzero(A.window_mask(bounds, shingle))
    begin, finish = starts[at], ends[at + shingle - 1] if len(at) else at
    doc = A.doc_of(bounds)[at]
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    hashes = A.xxh64_spans(packed, np.r_[begin, starts[bounds[short]]], np.r_[finish, ends[bounds[short + 1] - 1]], seed)
    fp = majority_bits(hashes[: len(at)], doc, n_docs)
    fp[short] = hashes[len(at) :]
    return {"id": rows.column(0), "fp": fp.view(np.int64)} | ({"print": rows.column("print")} if "print" in rows.schema.names else {})


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int, printed: bool = False) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), *([("print", pa.string())] if printed else [])])
    return A.map_chunks(batches, "text", partial(_fingerprint_kernel, shingle=shingle, seed=seed), schema)


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)`` of every row, ``fp`` the 64-bit SimHash as a long.

    Words are runs of non-white-space with A-Z lower-cased, shingles keep
    repeats, and each is hashed by XXH64.  Fewer words than a shingle hash as
    one sequence; null, empty and blank texts have fingerprint zero.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, shingle=shingle, seed=seed), "id long, fp long")


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the entries i and j of ``label``, in place; labels are indices of smallest members."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def trie_forest(group: np.ndarray, fp: np.ndarray, budget: int) -> np.ndarray:
    """For distinct fingerprints sorted by (group, fp), the index of the smallest member of each one's component inside its group."""
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edge, n])
    edge, size = edge[size > 1], size[size > 1]
    if not len(edge):
        return label
    ones = np.zeros((BITS, n + 1), np.int32)
    for bit in range(BITS):
        np.cumsum((fp >> np.uint64(BITS - 1 - bit)) & np.uint64(1), out=ones[bit, 1:], dtype=np.int32)
    # Large shards first join at one bit: what that links is skipped below.
    for allowed in ([1, budget] if size.max() > _LARGE and budget > 1 else [budget]):
        stack = [(0, edge, edge + size, edge, edge + size, np.zeros(len(edge), np.int64))]
        while stack:
            depth, alo, ahi, blo, bhi, err = stack.pop()
            if len(alo) > _FRONTIER:
                half = len(alo) // 2
                stack += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, err))), (depth, *(x[:half] for x in (alo, ahi, blo, bhi, err)))]
                continue
            run = np.cumsum(np.r_[0, label[1:] != label[:-1]])
            joined = (run[alo] == run[ahi - 1]) & (run[blo] == run[bhi - 1]) & (label[alo] == label[blo])
            live = ~joined
            alo, ahi, blo, bhi, err = (x[live] for x in (alo, ahi, blo, bhi, err))
            leaves = (ahi - alo == 1) & (bhi - blo == 1)
            if leaves.any():
                i, j = alo[leaves], blo[leaves]
                below = ~np.uint64(0) >> np.uint64(depth) if depth < BITS else np.uint64(0)
                near = err[leaves] + np.bitwise_count((fp[i] ^ fp[j]) & below) <= allowed
                _merge(label, i[near], j[near])
                alo, ahi, blo, bhi, err = (x[~leaves] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
            c = ones[depth]
            amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
            own = alo == blo  # a node with itself: its two halves meet once
            cross = np.flatnonzero(~own)
            parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), tuple(x[cross] for x in (amid, ahi, blo, bmid, err + 1))]
            alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts))
            ok = (alo < ahi) & (blo < bhi) & (err <= allowed) & ((alo != blo) | (ahi - alo > 1))
            if ok.any():
                stack.append((depth + 1, *(x[ok] for x in (alo, ahi, blo, bhi, err))))
    return label


def _forest_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges of the forests of all shards; rows come sorted by shard and, unsigned, by fingerprint."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(key, fp):
        first = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
        key, fp = key[first], fp[first]
        root = trie_forest(key, fp, budget)
        child = np.flatnonzero(root != np.arange(len(root)))
        a, b = fp[root[child]].view(np.int64), fp[child].view(np.int64)
        for k in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 16)]), pa.array(b[k : k + (1 << 16)])], schema=schema)

    keys, fps, held = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy().view(np.uint64))
        held += batch.num_rows
        if held >= SLICE:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            whole = int(np.searchsorted(key, key[-1]))  # the last shard may go on
            if whole:
                yield from edges(key[:whole], fp[:whole])
            keys, fps, held = [key[whole:]], [fp[whole:]], len(key) - whole
    if held:
        yield from edges(np.concatenate(keys), np.concatenate(fps))


def hamming_edges(fps: DataFrame, max_bits: int = 3, shard_cap: int = SHARD_CAP) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` that a chain of links of ``max_bits`` differing bits joins."""
    if not 0 <= max_bits < BITS:
        raise ValueError(f"max_bits must be from 0 to {BITS - 1}")
    cuts = [k * BITS // (max_bits + 1) for k in range(max_bits + 2)]
    values = F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", lo) if k else F.col("fp"), BITS - (hi - lo)).alias("value"))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ])
    rows = fps.select("fp", F.explode(values).alias("s")).select("fp", "s.block", "s.value")
    hot = rows.groupBy("block", "value").count().where(F.col("count") > shard_cap)
    parts = hot.select("block", "value", F.ceil(F.col("count") / shard_cap).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = (
        rows.join(parts, ["block", "value"], "left")
        .select("fp", "block", "value", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
        .select(F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp")
    )
    n = parallelism(fps.sparkSession)
    return dealt.repartition(n, "shard").sortWithinPartitions("shard", F.col("fp") < 0, "fp").mapInArrow(partial(_forest_batches, budget=max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, max_bits: int = 3, shard_cap: int = SHARD_CAP) -> DataFrame:
    """``(id, fp, component_id)`` per row: ``component_id`` is the smallest id reachable over links of ``max_bits`` bits or fewer.

    Rows with equal fingerprints are linked, so repeated rows and all texts
    without words fall together.  A null id is kept as a row; it can be linked
    through but is never a component's smallest id unless the component has no
    other.  Links of a third of all rows cost one row per distinct fingerprint.
    """
    marked = durable(simhash_fingerprints(docs, id_col, text_col, shingle, seed))
    return spread_join(marked, _components(marked, max_bits, shard_cap), "fp", "n").select("id", "fp", "component_id")


def _components(marked: DataFrame, max_bits: int, shard_cap: int) -> DataFrame:
    """``(fp, root, component_id, n)`` of each fingerprint; ``root`` tells components apart whose smallest ids are equal or null, ``n`` counts rows."""
    distinct = durable(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(hamming_edges(distinct, max_bits, shard_cap), "a", "b").select(F.col("node").alias("fp"), "root")
    labelled = durable(distinct.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    smallest = durable(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    return durable(spread_join(labelled, smallest, "root", "fps").select("fp", "root", "component_id", "n"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, max_bits: int = 3, shard_cap: int = SHARD_CAP) -> DataFrame:
    """One row of each group of ``near_duplicates``, the one with the smallest id, with its columns.

    Of rows that repeat that id inside the group, the text with the smallest MD5
    stays; of rows that repeat both, any one.  Rows of other groups stay whatever
    their ids are.
    """
    told = docs.withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_print": F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    rows = told.select(F.col("_id").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col("_print").alias("print"))
    marked = durable(rows.mapInArrow(partial(_fingerprint_batches, shingle=shingle, seed=seed, printed=True), "id long, fp long, print string"))
    found = spread_join(marked, _components(marked, max_bits, shard_cap), "fp", "n").where(F.col("id").eqNullSafe(F.col("component_id")))
    copies = found.groupBy("root", "id", "print").agg(F.count(F.lit(1)).alias("n"))
    kept = durable(copies.groupBy("root").agg(F.min(F.struct("print", "id", "n")).alias("k")).select(F.col("k.id").alias("_kept"), F.col("k.print").alias("_kept_print"), "k.n"))
    rest = told.join(kept.drop("n"), F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_print") == F.col("_kept_print")), "left_semi")
    return (rest if kept.where("n > 1").isEmpty() else rest.dropDuplicates(["_id", "_print"])).drop("_id", "_print")
