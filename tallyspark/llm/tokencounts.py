"""Exact token counts of texts of any length, huge ones in overlapping chunks.

A splitting pattern reads a text from left to right and keeps nothing but its
place, so two readings that begin a word at the same character go on alike, as
far as both can see.  A chunk is encoded with the offsets of its tokens; the next
one begins before it ends.  Where both begin a word at the same character of
their overlap, and the earlier one still sees ``margin`` characters behind it (all
that the pattern looks ahead, and the longest special string), the two are
spliced there: the tokens before it are those of the earlier chunk, the others
those of the later one.  Byte-pair merges stay within words, so the sum is the
count of the whole text.  Texts some of whose overlaps have no such place, as
those of words longer than an overlap, are cut anew with overlaps four times as wide.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .packing import load_encoder
from .runtime import durable

#: Characters that the splitting pattern of byte-level BPE looks ahead, with room to spare.
LOOK_AHEAD = 16
#: Chunks in an Arrow batch.
_BATCH = 32
_SPLICES = "array<struct<at: bigint, rank: bigint>>"


@lru_cache(maxsize=4)
def _spec(path: str) -> dict:
    from tokenizers import Tokenizer

    return json.loads(Tokenizer.from_file(path).to_str())


@lru_cache(maxsize=4)
def margin_of(path: str) -> int | None:
    """Characters behind a place that decide whether a word begins there; None if the file's rules don't promise that splices are stable.

    They do for byte-level BPE that splits by its own pattern, takes texts as they
    are and has special strings that take no neighbours along.
    """
    if not path.endswith(".json"):
        return None
    spec = _spec(path)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("normalizer")
    split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    return max([LOOK_AHEAD, *(len(t["content"]) + LOOK_AHEAD for t in added)]) if plain and split and alone else None


@lru_cache(maxsize=4)
def load_counter(path: str) -> Callable[[str], int]:
    """The number of tokens of a single text: ``.json`` as ``tokenizers`` has it, ``.model`` as ``sentencepiece``."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    if margin_of(path) is not None:
        encode = load_encoder(path)[0]
        return lambda text: len(encode(text))
    whole = _whole(path)
    return lambda text: len(whole.encode(text, add_special_tokens=False))


@lru_cache(maxsize=4)
def _whole(path: str):
    """The file's tokenizer without truncation, padding, or a last step that would trim offsets."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json.dumps(_spec(path) | {"post_processor": None, "truncation": None, "padding": None}))


def word_starts(path: str, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters where words begin, the number of tokens before each, and the number of all tokens."""
    coded = _whole(path).encode(text, add_special_tokens=False)
    words = np.array(coded.word_ids, dtype=np.int64)
    rank = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
    at = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)[rank, 0]
    return at, rank, len(words)


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = load_counter(path)
    for batch in batches:
        for lo, hi, _, _ in A.chunks(batch.column("text")):
            rows = batch.slice(lo, hi - lo)
            n = pa.array([count(t or "") for t in rows.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("n_bytes"), n], names=["id", "n_bytes", "n_tokens"])


def _cut_batches(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks ``(print, chunk, last, text)``; each but the last reaches ``overlap`` characters into the next."""
    schema = pa.schema([("print", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
    for batch in batches:
        for row in range(batch.num_rows):
            known, text = batch.column("print")[row].as_py(), batch.column("text")[row].as_py()
            n = max(1, -(-(len(text) - overlap) // chunk))
            for low in range(0, n, _BATCH):
                ks = range(low, min(n, low + _BATCH))
                yield pa.RecordBatch.from_pylist([{"print": known, "chunk": k, "last": k == n - 1, "text": text[k * chunk : (k + 1) * chunk + overlap]} for k in ks], schema=schema)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int, margin: int) -> Iterator[pa.RecordBatch]:
    """Per chunk its tokens, and the places of its two overlaps where it may be spliced, counted from the overlap's beginning."""
    places = pa.list_(pa.struct([("at", pa.int64()), ("rank", pa.int64())]))
    schema = pa.schema([("print", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("head", places), ("tail", places)])
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            known, k, last, text = (column[row].as_py() for column in batch.columns)
            at, rank, n = word_starts(path, text)
            within = lambda low: [{"at": a - low, "rank": r} for a, r in zip(at.tolist(), rank.tolist()) if low <= a <= low + overlap - margin]  # noqa: B023, E731
            out.append({"print": known, "chunk": k, "n": n, "head": within(0) if k else [], "tail": [] if last else within(chunk)})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def splice(pieces: DataFrame) -> DataFrame:
    """``(print, n_tokens, unaligned)`` from the chunks' counts and places; ``unaligned`` overlaps have no place in common."""
    before = pieces.select("print", (F.col("chunk") + 1).alias("chunk"), F.col("n").alias("n_before"), "tail")
    joints = before.join(pieces.where("chunk > 0").select("print", "chunk", "head"), ["print", "chunk"])
    at = lambda c: F.transform(c, lambda x: x["at"])
    joints = joints.withColumn("at", F.array_min(F.array_intersect(at(F.col("tail")), at(F.col("head")))))
    rank = lambda c: F.get(F.filter(c, lambda x: x["at"] == F.col("at")), F.lit(0))["rank"]
    # tokens of the earlier chunk from the splice on, and of the later one before it, are not the text's
    surplus = F.coalesce(F.col("n_before") - rank("tail") + rank("head"), F.lit(0))
    parts = pieces.select("print", F.col("n").alias("n"), F.lit(0).alias("open")).unionAll(joints.select("print", -surplus, F.col("at").isNull().cast("int")))
    return parts.groupBy("print").agg(F.sum("n").alias("n_tokens"), F.sum("open").alias("unaligned"))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap_chars: int = 256) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row, as the tokenizer's own library counts the whole text.

    Null and empty texts have no bytes and no tokens; repeated rows are counted
    again; ids may be null or repeated, and no other column is touched.  Texts of
    more than ``chunk_chars`` and an overlap are cut into chunks that are encoded
    in tasks of their own, equal chunks of equal texts once.  A task holds one
    text while it cuts it.  Tokenizers whose splices are not known to be stable
    (``margin_of``) encode every text whole.  An empty table has no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    whole = lambda df: df.mapInArrow(partial(_count_batches, path=tokenizer_path), f"id {kind}, n_bytes long, n_tokens long")
    margin = margin_of(tokenizer_path)
    if margin is None:
        return whole(rows)
    overlap = max(overlap_chars, 2 * margin)
    chunk = max(chunk_chars, overlap)
    huge = F.length("text") > chunk + overlap
    keyed = rows.where(huge).withColumn("print", F.sha2("text", 256))
    texts, counted = keyed.select("print", "text"), []
    while True:
        cut = texts.mapInArrow(partial(_cut_batches, chunk=chunk, overlap=overlap), "print string, chunk long, last boolean, text string")
        dealt = cut.groupBy("print", "chunk").agg(F.first("last").alias("last"), F.first("text").alias("text"))
        coded = dealt.mapInArrow(partial(_encode_batches, path=tokenizer_path, chunk=chunk, overlap=overlap, margin=margin), f"print string, chunk long, n long, head {_SPLICES}, tail {_SPLICES}")
        sums = durable(splice(durable(coded)))
        counted.append(sums.where("unaligned = 0").select("print", "n_tokens"))
        again = sums.where("unaligned > 0").select("print")
        if again.isEmpty():
            break
        texts = texts.join(again, "print", "left_semi")
        overlap *= 4
        chunk = max(chunk, overlap)
    known = reduce(DataFrame.unionAll, counted)
    return whole(rows.where(~huge)).unionAll(keyed.select("id", "n_bytes", "print").join(known, "print").select("id", "n_bytes", "n_tokens"))
