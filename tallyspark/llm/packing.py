"""Packing documents into fixed-length training sequences, in order.

Token ids of consecutive documents form a stream that is cut into windows.
Dynamic programming over cut places, which are all document and sentence ends,
minimises padding plus penalties for cutting documents; each transition takes a
minimum over a sliding range of earlier cuts, kept in a monotone queue.  A full window may also end inside a sentence, at the
truncation penalty, which is what that has to save in padding; longer sentences
than a window have to be cut so.  Partitions pack their own documents in slices
of bounded size, so nothing is shuffled or gathered.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

#: Penalties in padded tokens: a cut at a document's end is free, one inside a sentence is a truncation.
SENTENCE_CUT, HARD_CUT = 0.5, 64
#: The pattern that byte-level BPE splits by (a fixed value of that format).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level BPE files use for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_encoder(path: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """An encoder of single texts and a table of the ids that end a sentence.

    Files of plain byte-level BPE run on ``tiktoken``, which gives the same ids
    several times faster; other files, texts with the strings of special tokens
    and texts that it refuses go to ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    spec = json.loads(slow.to_str())
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    by_library = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    size = slow.get_vocab_size()
    ends = np.zeros(size, bool)
    for k in range(size):
        piece = slow.decode([k], skip_special_tokens=False)
        ends[k] = "\n" in piece or piece.rstrip("\"')]}»” ").endswith((".", "!", "?", "。", "！", "？", "…"))
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout"):
        return by_library, ends
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): k for token, k in model["vocab"].items() if token not in specials}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(order, order[1:])):
        return by_library, ends
    import tiktoken

    fast = tiktoken.Encoding("byte-level", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in specials):
            return by_library(text)
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except Exception:  # its regular expressions give up on some texts
            return by_library(text)

    return encode, ends


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> np.ndarray:
    """Where windows may end: 0, all ends of documents and sentences, and inside of stretches longer than ``length``
    the ends of full windows that follow any of the places up to a window before the stretch."""
    places = np.union1d(np.r_[0, doc_ends], sentence_ends)
    more = []
    for g in np.flatnonzero(np.diff(places) > length).tolist():
        low, high = int(places[g]), int(places[g + 1])
        near = places[np.searchsorted(places, low - length, side="right") : g + 1]
        full = near[:, None] + length * np.arange(1, (high - low) // length + 2)
        more.append(full[(full > low) & (full < high)])
    return np.union1d(places, np.concatenate(more)) if more else places


def choose_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int, sentence_cut: float = SENTENCE_CUT, hard_cut: float = HARD_CUT) -> np.ndarray:
    """Cut places, from 0 to the stream's end, of windows of ``length`` tokens at most with the least padding plus penalties.

    A transition is one window between two places, or a full window that is cut
    wherever it ends, at ``hard_cut``, and another one behind it.
    """
    places = cut_places(doc_ends, sentence_ends, length)
    cost = np.full(len(places), float(hard_cut))
    cost[np.searchsorted(places, sentence_ends)] = sentence_cut
    cost[np.searchsorted(places, np.r_[0, doc_ends])] = 0
    pos, m = places.tolist(), len(places)
    back, keys = [0] * m, [0.0] * m  # keys: the least cost up to a place, plus the place; costs of transitions then differ by the source's key alone
    whole = np.zeros(m, bool)  # whether a full window comes first
    one, two = deque([0]), deque()  # places the last window, or the full one before it, may begin at; keys growing
    entering = 0
    penalty = cost.tolist()
    for j in range(1, m):
        at = pos[j]
        low = at - length
        while pos[one[0]] < low:
            one.popleft()
        source = one[0]
        key = keys[source] + length
        while pos[entering] < low:
            k = keys[entering]
            while two and keys[two[-1]] >= k:
                two.pop()
            two.append(entering)
            entering += 1
        low -= length
        while two and pos[two[0]] < low:
            two.popleft()
        if two and (other := keys[two[0]] + 2 * length + hard_cut) < key:
            source, key = two[0], other
            whole[j] = True
        back[j] = source
        key = keys[j] = key + penalty[j]
        while one and keys[one[-1]] >= key:
            one.pop()
        one.append(j)
    cuts, j = [pos[m - 1]], m - 1
    while j > 0:
        if whole[j]:
            cuts.append(pos[back[j]] + length)
        j = back[j]
        cuts.append(pos[j])
    return np.array(cuts[::-1])


def _split_last(cuts: np.ndarray, length: int, most: int) -> np.ndarray:
    """The last window in powers of two, which need no padding, if more than ``most`` tokens would be padded."""
    if len(cuts) < 2 or length - (cuts[-1] - cuts[-2]) <= most:
        return cuts
    size, at, more = int(cuts[-1] - cuts[-2]), int(cuts[-2]), []
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            at += 1 << bit
            more.append(at)
    return np.r_[cuts[:-1], more]


_FIELDS = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, chunk_bytes: int, with_ids: bool, most: int) -> Iterator[pa.RecordBatch]:
    encode, sentence = load_encoder(path)
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 40
    schema = pa.schema(_FIELDS if with_ids else _FIELDS[:-1])
    for batch in batches:
        for lo, hi, _, _ in A.chunks(batch.column("text"), chunk_bytes):
            rows = batch.slice(lo, hi - lo)
            tail = np.array([end_id], np.uint32)
            parts = [x for text in rows.column("text").to_pylist() for x in (encode(text or ""), tail)]
            sizes = np.array([len(parts[k]) + 1 for k in range(0, len(parts), 2)])
            stream = np.concatenate(parts).astype("<u4")
            doc_ends = np.cumsum(sizes)
            cuts = _split_last(choose_cuts(doc_ends, np.flatnonzero(sentence[stream]) + 1, length), length, most)
            edges = np.union1d(cuts, np.r_[0, doc_ends])
            start, stop = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_ends, start, side="right")
            sequence = np.searchsorted(cuts, start, side="right") - 1
            raw = memoryview(stream.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist())]
            columns = [rows.column("id").take(pa.array(doc)), start - (doc_ends - sizes)[doc], stop - start, np.array(crc, np.int64), sizes[doc], number + sequence, start - cuts[sequence]]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(stream.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)
            number += len(cuts) - 1


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, with_ids: bool = True, chunk_bytes: int = 4 << 20, most_padding: int = 64) -> DataFrame:
    """Pieces ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`` that hold every token of every row once.

    A row's tokens are its ids and ``end_id``; null and empty texts have that one
    id.  Sequences have ``length`` tokens at most; rows follow each other in
    the order of their partition, and a repeated row is packed again.  Sequence
    ids are unique, numbered by partition.  An empty table has no pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(partial(_pack_batches, path=tokenizer_path, length=length, end_id=end_id, chunk_bytes=chunk_bytes, with_ids=with_ids, most=most_padding), schema)
