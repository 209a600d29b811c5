"""Collocations of up to five words by Suffix-sigma.

Every word begins a suffix of its piece of text, cut after ``max_n`` words.  Equal
suffixes of a slice are added up and dealt out in the order of language and words, so that suffixes with one
first word stay together; a first word (or two, or three) too frequent for one
task is many tasks, since the bounds between tasks are suffixes, not words.  Each
task sorts its suffixes in reverse and counts all their prefixes in one pass with
one stack, which holds the prefixes that the present suffix shares with the one
before.  What lies inside a task is complete, and rare phrases go at once; the few
prefixes at a task's two ends are added up afterwards.

Words found less than ``min_count`` times can't be in a phrase, so suffixes end
before them.  Frequent words are written as numbers, by descending frequency, up to
``dictionary_words`` of them (the bound of what is broadcast); others as they are.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as A
from .runtime import durable, parallelism

_ALL = np.arange(256)
#: ``[.,;:!?\x0A-\x0D]`` ends a piece, ``[\x20\x09]`` a word.
IS_BREAK = np.isin(_ALL, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
IS_PHRASE_WORD = ~(IS_BREAK | (_ALL == 0x20) | (_ALL == 0x09))
#: Text bytes of a slice whose equal suffixes are added up.
SLICE_BYTES = 8 << 20
#: Longer words are always spelled out.
LONG_WORD = 64
#: A number is three digits of this base, so the byte 0xFF (never in UTF-8 either) only marks words that are spelled out.
_BASE = 255
_SPELLED = 1 << 24
#: For dealing out, a word takes this many bits; spelled words, the upper half, show the beginning of their bytes there.
_DEAL_BITS = 19
_DEAL_SPELLED = 1 << (_DEAL_BITS - 1)
#: Words that are broadcast, at most; fewer than half of what a word's bits can tell apart.
DICTIONARY_WORDS = 200_000
#: Suffixes of the sample that the bounds between tasks are taken from.
SAMPLE_SUFFIXES = 200_000


def _words(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray):
    """Distinct words of a slice, and of every word its number among them, its document and whether the next word follows in one piece."""
    low = A.LOWER[buf]
    starts, ends, bounds = A.spans(low, offsets, IS_PHRASE_WORD)
    doc = A.doc_of(bounds)
    piece = np.cumsum(IS_BREAK[low])[starts] if len(starts) else starts
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    body = low[: int(offsets[-1])]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(body[IS_PHRASE_WORD[body]])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), doc, follows


def _by_lang(rows: pa.RecordBatch, doc: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Languages of a slice and the words of each."""
    coded = rows.column("lang").dictionary_encode()
    of_doc = coded.indices.to_numpy()
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(of_doc[doc] == k)


def _word_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """Counts ``(lang, word, n)``, with an empty word for all words of a language."""
    distinct, number, doc, _ = _words(rows, buf, offsets)
    out = []
    for lang, at in _by_lang(rows, doc):
        n = np.bincount(number[at], minlength=len(distinct))
        some = np.flatnonzero(n)
        words = pa.concat_arrays([pa.array([b""], pa.large_binary()), distinct.take(pa.array(some))]).cast(pa.large_string()).cast(pa.string())
        out.append({"lang": pa.array([lang] * len(words), pa.string()), "word": words, "n": np.r_[len(at), n[some]]})
    return out


def _slices(batches: Iterator[pa.RecordBatch], kernel, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in A.chunks(batch.column("text"), SLICE_BYTES):
            for part in kernel(batch.slice(lo, hi - lo), buf, offsets):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (part[f.name] for f in schema)], schema=schema)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _slices(batches, _word_kernel, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


@lru_cache(maxsize=2)
def _unpacked(raw: bytes) -> dict:
    known = pickle.loads(raw)
    return known | {"words": {lang: pa.array(words, pa.large_binary()) for lang, words in known["words"].items()}}


def _suffixes(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, known: dict, max_n: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """Per language the distinct suffixes of a slice in order, as rows of word numbers with -1 behind the end, their counts, and the slice's words.

    Numbers from ``_SPELLED`` on are words of the slice that the dictionary lacks.
    """
    distinct, number, doc, follows = _words(rows, buf, offsets)
    sizes = pc.binary_length(distinct).to_numpy()
    for lang, at in _by_lang(rows, doc):
        have = known["words"].get(lang)
        code = pc.index_in(distinct, value_set=have).fill_null(-1).to_numpy().astype(np.int64) if have is not None and len(distinct) else np.full(len(distinct), -1)
        spelled = (code < 0) & ((sizes > LONG_WORD) | (not known["complete"]))
        code[spelled] = _SPELLED + np.flatnonzero(spelled)
        word = np.r_[code.astype(np.int32)[number[at]], np.full(max_n, -1, np.int32)]
        on = np.r_[follows[at], np.zeros(max_n, bool)]  # a document's words stand together
        first = np.flatnonzero(word[: len(at)] >= 0)
        if not len(first):
            continue
        columns, alive = [word[first]], np.ones(len(first), bool)
        for k in range(1, max_n):
            alive &= on[first + k - 1] & (word[first + k] >= 0)
            columns.append(np.where(alive, word[first + k], np.int32(-1)))
        order = np.lexsort(columns[::-1])
        table = np.column_stack(columns)[order]
        heads = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]).any(axis=1)])
        yield lang, table[heads], np.diff(np.r_[heads, len(table)]), distinct


def _deal_keys(table: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two integers that never contradict the order of the encoded suffixes: their first words, and of a spelled word its first bytes and nothing behind it."""
    small = np.zeros((len(table), 6), np.int64)
    small[:, : table.shape[1]] = table[:, :6] + 1
    odd = np.flatnonzero((table >= _SPELLED).any(axis=1))
    for k in odd.tolist():
        j = int((table[k] >= _SPELLED).argmax())
        begin = int.from_bytes(distinct[int(table[k, j]) - _SPELLED].as_py()[:8].ljust(8, b"\xff"), "big")
        small[k, j:] = [_DEAL_SPELLED + (begin >> 46), begin >> 27 & 0x7FFFF, begin >> 8 & 0x7FFFF, 0, 0, 0][: 6 - j]
    pack = lambda c: (small[:, c] << 2 * _DEAL_BITS) | (small[:, c + 1] << _DEAL_BITS) | small[:, c + 2]
    return pack(0), pack(3)


def _parts(table: np.ndarray, distinct: pa.Array, bounds: tuple[int, list[int], list[int]]) -> np.ndarray:
    """The task of each suffix: that of the language's first, and one more for each bound that is not above it."""
    base, one, two = bounds
    a, b = _deal_keys(table, distinct)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    low, high = np.searchsorted(a, one, side="left"), np.searchsorted(a, one, side="right")
    cut = [x + int(np.searchsorted(b[x:y], t, side="left")) for x, y, t in zip(low.tolist(), high.tolist(), two)]
    out = np.empty(len(a), np.int64)
    out[order] = base + np.searchsorted(np.array(cut, np.int64), np.arange(len(a)), side="right")
    return out


def _encoded(lang: str, table: np.ndarray, distinct: pa.Array) -> pa.Array:
    """Byte strings: the language, 0xFF, and the words, none of which another begins with."""
    prefix = np.frombuffer(lang.encode() + b"\xff", np.uint8)
    n = (table >= 0).sum(axis=1)
    whole = np.empty((len(table), len(prefix) + 3 * table.shape[1]), np.uint8)
    whole[:, : len(prefix)] = prefix
    for k in range(table.shape[1]):
        at, w = len(prefix) + 3 * k, table[:, k]
        whole[:, at], whole[:, at + 1], whole[:, at + 2] = w // _BASE**2, w // _BASE % _BASE, w % _BASE
    size = len(prefix) + 3 * n
    body = whole[np.arange(whole.shape[1]) < size[:, None]]
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(body)])
    odd = (table >= _SPELLED).any(axis=1)
    if not odd.any():
        return plain
    number = lambda w: bytes((w // _BASE**2, w // _BASE % _BASE, w % _BASE))
    word = lambda w: number(w) if w < _SPELLED else b"\xff" + distinct[w - _SPELLED].as_py() + b"\xff"
    told = [prefix.tobytes() + b"".join(word(w) for w in row if w >= 0) for row in table[odd].tolist()]
    return pc.replace_with_mask(plain, pa.array(odd), pa.array(told, pa.large_binary()))


def _suffix_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, model, max_n: int) -> Iterator[dict]:
    known = _unpacked(model.value)
    for lang, table, n, distinct in _suffixes(rows, buf, offsets, known, max_n):
        part = _parts(table, distinct, bounds_of(lang, known["bounds"]))
        yield {"part": part.astype(np.int32), "key": _encoded(lang, table, distinct).cast(pa.binary()), "n": n}


def _suffix_batches(batches: Iterator[pa.RecordBatch], model, max_n: int) -> Iterator[pa.RecordBatch]:
    return _slices(batches, partial(_suffix_kernel, model=model, max_n=max_n), pa.schema([("part", pa.int32()), ("key", pa.binary()), ("n", pa.int64())]))


def _sample_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, model, max_n: int) -> Iterator[dict]:
    for lang, table, _, distinct in _suffixes(rows, buf, offsets, _unpacked(model.value), max_n):
        one, two = _deal_keys(table, distinct)
        yield {"lang": pa.array([lang] * len(table), pa.string()), "one": one, "two": two}


def _sample_batches(batches: Iterator[pa.RecordBatch], model, max_n: int) -> Iterator[pa.RecordBatch]:
    return _slices(batches, partial(_sample_kernel, model=model, max_n=max_n), pa.schema([("lang", pa.string()), ("one", pa.int64()), ("two", pa.int64())]))


def bounds_of(lang: str, bounds: list[tuple[bytes, int, int]]) -> tuple[int, list[int], list[int]]:
    """Of sorted bounds, the number of those before a language and its own."""
    name = lang.encode() + b"\xff"  # as keys begin
    low, high = bisect_left(bounds, (name, -1, -1)), bisect_left(bounds, (name + b"\x00", -1, -1))
    return low, [b[1] for b in bounds[low:high]], [b[2] for b in bounds[low:high]]


class Stack:
    """Counts of the prefixes of sorted suffixes, read batch by batch; open are those that the last suffix read begins with."""

    def __init__(self, known: dict, max_n: int, least: int):
        self.words, self.max_n, self.least = known["words"], max_n, least
        self.spelled: list[bytes] = []  # words of this task that the dictionary lacks
        self.number: dict[bytes, int] = {}
        self.open: list[tuple[bytes, tuple[int, ...], int, bool]] = []  # language, words, count, whether the task's first suffix begins with it
        self.begun = False
        self.out: list[tuple[str, str, int, int]] = []

    def _numbers(self, key: bytes) -> list[int]:
        at, out = 0, []
        while at < len(key):
            if key[at] == 0xFF:
                end = key.index(b"\xff", at + 1)
                word = key[at + 1 : end]
                k = self.number.setdefault(word, len(self.spelled))
                if k == len(self.spelled):
                    self.spelled.append(word)
                out.append(_SPELLED + k)
                at = end + 1
            else:
                out.append(key[at] * _BASE**2 + key[at + 1] * _BASE + key[at + 2])
                at += 3
        return out

    def _table(self, keys: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Languages, the language of each row by number, and its words with -1 behind the end."""
        data, offsets = A.column_buffer(keys)
        marks = np.flatnonzero(data == 0xFF)
        first = np.searchsorted(marks, offsets[:-1])
        many = np.searchsorted(marks, offsets[1:]) - first > 1
        body = marks[first] + 1
        padded = np.r_[data, np.zeros(3 * self.max_n, np.uint8)].astype(np.int64)
        at = body[:, None] + 3 * np.arange(self.max_n)
        table = np.where(at < offsets[1:, None], padded[at] * _BASE**2 + padded[at + 1] * _BASE + padded[at + 2], -1)
        for k in np.flatnonzero(many).tolist():
            numbers = self._numbers(data[body[k] : offsets[k + 1]].tobytes())
            table[k] = numbers + [-1] * (self.max_n - len(numbers))
        # rows are sorted, so a language is one run
        langs, of_row, k = [], np.zeros(len(keys), np.int64), 0
        name = lambda i: data[offsets[i] : body[i] - 1].tobytes()
        while k < len(keys):
            langs.append(name(k))
            low, high = k, len(keys)
            while high - low > 1:  # the last row of this language
                middle = (low + high) // 2
                low, high = (middle, high) if name(middle) == langs[-1] else (low, middle)
            of_row[k:high] = len(langs) - 1
            k = high
        return langs, of_row, table

    def _phrase(self, lang: bytes, words: tuple[int, ...]) -> str:
        have = self.words.get(lang.decode())
        return b" ".join(self.spelled[w - _SPELLED] if w >= _SPELLED else have[w].as_py() for w in words).decode()

    def _close(self, lang: bytes, words: tuple[int, ...], n: int, at_end: bool) -> None:
        if n >= self.least or at_end:
            self.out.append((lang.decode(), self._phrase(lang, words), len(words), n))

    def read(self, keys: pa.Array, n: np.ndarray) -> None:
        langs, of_row, table = self._table(keys)
        fresh = np.r_[True, of_row[1:] != of_row[:-1]]  # whether a row begins another prefix than the row before
        still: list[tuple[bytes, tuple[int, ...], int, bool]] = []
        for depth in range(1, self.max_n + 1):
            column = table[:, depth - 1]
            fresh = fresh | np.r_[True, column[1:] != column[:-1]]
            heads = np.flatnonzero(fresh)
            sums = np.add.reduceat(n, heads)
            before = next((x for x in self.open if len(x[1]) == depth), None)
            last = len(heads) - 1
            worth = np.flatnonzero((column[heads] >= 0) & (sums >= self.least))
            for k in np.union1d(worth, [0, last]).tolist():  # ends may go on in other batches or tasks
                row = heads[k]
                lang, words = langs[of_row[row]], tuple(table[row, :depth].tolist())
                if k == 0 and before and before[:2] != (lang, words):
                    self._close(*before)
                    before = None
                if words[-1] < 0:
                    continue
                count, opening = int(sums[k]), k == 0 and not self.begun
                if k == 0 and before:
                    count, opening = count + before[2], before[3]
                if k == last:
                    still.append((lang, words, count, opening))
                else:
                    self._close(lang, words, count, opening)
        self.open, self.begun = still, True

    def close(self) -> None:
        for lang, words, n, _ in self.open:
            self._close(lang, words, n, True)
        self.open = []


_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def _count_batches(batches: Iterator[pa.RecordBatch], model, max_n: int, least: int) -> Iterator[pa.RecordBatch]:
    stack = Stack(_unpacked(model.value), max_n, least)
    told = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stack.out) if stack.out else [[]] * 4, _FOUND)], schema=_FOUND)
    for batch in batches:
        if batch.num_rows:
            stack.read(batch.column("key"), batch.column("n").to_numpy())
            yield told()
            stack.out = []
    stack.close()
    yield told()


def frequent_phrases(texts: DataFrame, min_count: int = 100, max_n: int = 5, dictionary_words: int = DICTIONARY_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)``, the words of each language, and ``(lang, phrase, words, f)``, its phrases of up to ``max_n`` words found ``min_count`` times."""
    spark = texts.sparkSession
    seen = texts.mapInArrow(_word_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = durable(seen.where((F.col("word") == "") | (F.col("n") >= min_count)))
    totals = counts.where("word = ''").select("lang", "n")
    short = counts.where((F.col("word") != "") & (F.octet_length("word") <= LONG_WORD))
    complete = short.count() <= dictionary_words
    chosen = (short if complete else short.orderBy(F.desc("n"), "lang", "word").limit(dictionary_words)).toPandas().sort_values(["lang", "n", "word"], ascending=[True, False, True])
    words = {lang: [w.encode() for w in group["word"]] for lang, group in chosen.groupby("lang")}
    share = lambda bounds: spark.sparkContext.broadcast(pickle.dumps({"words": words, "complete": complete, "bounds": bounds}))
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    # the sample only decides how suffixes are dealt out, not what is counted
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_SUFFIXES / max(1, all_words))))
    near = sampled.mapInArrow(partial(_sample_batches, model=share([]), max_n=max_n), "lang string, one long, two long").limit(4 * SAMPLE_SUFFIXES).toPandas()
    keys = sorted(zip((x.encode() + b"\xff" for x in near["lang"]), near["one"].tolist(), near["two"].tolist()))
    tasks = parallelism(spark)
    bounds = sorted({keys[len(keys) * k // tasks] for k in range(1, tasks)}) if keys else []
    model = share(bounds)
    suffixes = texts.mapInArrow(partial(_suffix_batches, model=model, max_n=max_n), "part int, key binary, n long")
    dealt = suffixes.repartitionById(len(bounds) + 1, F.col("part")).select("key", "n").sortWithinPartitions(F.desc("key"))
    counted = dealt.mapInArrow(partial(_count_batches, model=model, max_n=max_n, least=min_count), "lang string, phrase string, words int, f long")
    return totals, durable(counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_n: int = 5, top: int = 2000, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``max_n`` words by their weakest cut.

    A phrase found ``a`` times scores ``floor(1000 * a * n / (l * r))`` at a cut into
    parts found ``l`` and ``r`` times, ``n`` being the language's words; the lowest
    score counts, the earliest cut among equals.  Phrases inside a longer one that
    is found as often are left out.

    Null texts have no words, null languages are ``und``; copies and repeated rows
    count each time.  A language without a phrase of ``min_count`` has no rows, nor
    has an empty table.  Texts of any length are read in slices; a phrase of any length in
    bytes is kept whole.  Other columns are not read, whatever their names.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang")
    totals, phrases = frequent_phrases(docs.select(lang, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), min_count, max_n, dictionary_words)
    word = F.split("phrase", " ")
    part = lambda low, n: F.array_join(F.slice("word", low, n), " ")
    long = phrases.where("words > 1").withColumn("word", word)
    # a phrase inside a longer one that is as frequent is also inside one of one word more, which then is as frequent too
    wider = long.where("words > 2").select("lang", F.explode(F.array(part(1, F.col("words") - 1), part(2, F.col("words") - 1))).alias("phrase"), "f")
    wider = wider.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = long.join(wider, ["lang", "phrase"], "left").where("most IS NULL OR most < f").drop("most")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "word", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    count = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    known = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # 38 digits hold all products; integral division of decimals is exact
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = known.withColumn("_up", (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("_down", wide("l") * wide("r")).withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the best of shares of a language first, so that none is gathered
    share = F.pmod(F.xxhash64("phrase"), F.lit(min(256, parallelism(docs.sparkSession))))
    near = best.withColumn("_share", share).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_nth") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
