"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and
signs that stand for letters to those letters.  Folding keeps the length, so a
match can be checked against the original.  The lexicon holds word beginnings;
their weights (log odds, less one standard error) are learned from labelled
documents.  A document's matches, outside exception phrases, are summed up,
normalised by its length, and mapped to a probability.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .runtime import durable

#: English stems that count as toxic from the start.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "imbecile", "retard", "dumbass", "bastard", "bitch", "asshole", "fuck", "shit", "cunt", "whore", "slut")
#: Phrases in which a stem is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "pond scum", "soap scum", "loser pays", "white trash can", "disgusting smell", "shitake", "scumble", "clown fish", "worthless check", "stupid question")
#: Letters of other scripts, digits and signs, and the Latin letters they are read as.
HOMOGLYPHS = {
    "аɑαａ": "a", "ЬьƄｂ": "b", "сϲｃ": "c", "ԁｄ": "d", "еεҽｅ": "e", "ｆ": "f", "ɡｇ": "g", "һｈ": "h", "іιıｉ": "i", "јｊ": "j", "кκｋ": "k", "ӏⅼｌ": "l", "мｍ": "m", "пηｎ": "n", "оοσｏ": "o",
    "рρｐ": "p", "ԛｑ": "q", "гｒ": "r", "ѕｓ": "s", "тτｔ": "t", "υսｕ": "u", "νѵｖ": "v", "ѡωｗ": "w", "хχｘ": "x", "уγｙ": "y", "ｚ": "z",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_TABLE = {ord(c): latin for many, latin in HOMOGLYPHS.items() for c in many} | {ord(c): x for c, x in DIGITS.items()}
_TABLE |= {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) not in DIGITS}
_TABLE |= {ord(c): " " for c in "«»“”‘’„‚…–—¿¡·•   　"}
_STEM = range(4, 9)
_WORD = re.compile(r"[^ ]+")


def fold(text: str) -> str:
    """The text as the lexicon sees it, of the same length."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased
        low = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, text))
    return low.translate(_TABLE)


class Lexicon:
    """Weighted stems and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for stem, weight in weights.items():
            self.automaton.add_word(" " + stem, (weight, 0, len(stem)))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (0.0, len(phrase), 0))
        if weights or exceptions:
            self.automaton.make_automaton()

    def total(self, text: str) -> float:
        """Sum over words of the largest weight that fits them, outside exceptions."""
        best: dict[int, float] = {}
        spared: list[list[int]] = []  # ends come in order: a phrase that reaches back over earlier ones takes them in
        for end, (weight, phrase, stem) in self.automaton.iter(" " + fold(text) + " "):
            if phrase:
                low = end - phrase - 1
                while spared and spared[-1][1] >= low:
                    low = min(low, spared.pop()[0])
                spared.append([low, end])
            elif weight > best.get(end - stem, 0.0):
                best[end - stem] = weight
        found, letter = [], len(text)
        until = len(text)  # what the last step has looked at begins here; letter is the first letter or blank from there on
        for at in sorted(best, reverse=True):
            while spared and spared[-1][0] > at:
                spared.pop()
            if spared and at < spared[-1][1]:
                continue
            # a number is no word: at is the place in text as well
            letter = next((k for k in range(at, until) if text[k].isspace() or text[k].isalpha()), letter)
            until = at
            if letter < len(text) and text[letter].isalpha():
                found.append(best[at])
        return math.fsum(found)


def _features(lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
    """Per text: log of the matched weight, and log of it per hundred words."""
    out = np.zeros((len(texts), 2))
    for k, text in enumerate(texts):
        if text and (total := lexicon.total(text)):
            out[k] = math.log1p(total), math.log1p(100 * total / max(1, len(text.split())))
    return out


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of the text's 3-word runs (its words alone decide): copies and most near copies share it."""
    for batch in batches:
        least = np.zeros(batch.num_rows, np.uint64)
        for lo, _, buf, offsets in A.chunks(batch.column("text")):
            starts, ends, bounds = A.spans(buf, offsets, A.IS_WORD)
            words = A.hash_spans(buf, starts, ends)
            best = np.full(len(bounds) - 1, ~np.uint64(0))
            n_words = np.diff(bounds)
            for size in (3, 2, 1):  # a shorter text is one run
                at = np.flatnonzero(A.window_mask(bounds, size))
                doc = A.doc_of(bounds)[at]
                fits = n_words[doc] >= 3 if size == 3 else n_words[doc] == size
                np.minimum.at(best, doc[fits], A.windows(words, size)[at[fits]])
            least[lo : lo + len(best)] = best
        yield batch.append_column("signature", pa.array(least.view(np.int64)))


def stems_of(text: str) -> set[str]:
    """All word beginnings a lexicon may hold that the text has."""
    return {w[:n] for w in set(_WORD.findall(fold(text))) for n in _STEM if len(w) >= n}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(stems_of(text or ""))
    rows = [(s, n, counts[0][s]) for s, n in counts[1].items()] + [(s, 0, n) for s, n in counts[0].items() if s not in counts[1]]
    for k in range(0, len(rows), 1 << 15):
        part = list(zip(*rows[k : k + (1 << 15)]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], names=["stem", "t", "c"])


def _evidence(t: float, c: float, toxic: int, clean: int) -> float:
    """Log odds of toxicity given a stem, less one standard error."""
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) - math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def choose_stems(found: list[tuple[str, int, int]], toxic: int, clean: int, min_share: float = 0.03, min_docs: int = 4, min_evidence: float = 2.3) -> dict[str, float]:
    """Stems with enough evidence; none whose evidence is that of a longer or shorter stem that was taken."""
    support = max(min_docs, min_share * toxic)
    ranked = sorted(((_evidence(t, c, toxic, clean), -len(s), s, t, c) for s, t, c in found if t >= support), reverse=True)
    chosen: dict[str, float] = {}
    longer: dict[str, tuple[int, int]] = {}
    for evidence, _, stem, t, c in ranked:
        if evidence < min_evidence:
            break
        if any(stem[:n] in chosen for n in _STEM if n < len(stem)):
            continue
        explained = longer.get(stem, (0, 0))
        t, c = t - explained[0], c - explained[1]
        if t < support or (evidence := _evidence(t, max(c, 0), toxic, clean)) < min_evidence:
            continue
        chosen[stem] = evidence
        for n in _STEM:
            if n < len(stem):
                a, b = longer.get(stem[:n], (0, 0))
                longer[stem[:n]] = (a + t, b + c)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method; the first coefficient is the intercept."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _feature_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(pickle.loads(model.value)["stems"])
    for batch in batches:
        x = _features(lexicon, batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "x1", "x2"])


def _strong(toxic: int, clean: int, min_share: float = 0.03, min_docs: int = 4, min_evidence: float = 2.3):
    """The stems that ``choose_stems`` may take: those with support and evidence of their own."""
    t, c = F.col("t"), F.col("c")
    odds = F.log(t + 0.5) - F.log(F.lit(toxic + 1.0)) - F.log(c + 0.5) + F.log(F.lit(clean + 1.0))
    return (t >= max(min_docs, min_share * toxic)) & (odds - F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= min_evidence - 1e-9)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``(text, toxic)`` of a hashed sample of about ``max_rows`` labelled rows, near copies once, by the row with the smallest id and then text."""
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    marked = given.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    share = min(1.0, max_rows / max(1, marked.count()))
    sample = marked.where(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # its size is bounded by max_rows, but for the luck of the hash
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    signed = rows.mapInArrow(_signature_batches, f"{schema}, signature long")
    return signed.groupBy("signature", "toxic").agg(F.min(F.struct("id", "text")).alias("first")).select(F.col("first.text").alias("text"), "toxic")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> dict:
    """A model from labelled documents, of which a hashed sample of about ``max_rows`` is used (the documented bound).

    Rows without a label or id, and ids with both labels, are left out; a null
    text counts as empty.  Near copies count once, by a shared min-hash, so a
    document with many copies can't put its words into the lexicon; which of them
    stays does not depend on the order of rows.
    """
    spark = docs.sparkSession
    kept = durable(labelled_texts(docs, labels, id_col, text_col, label_col, max_rows))
    sizes = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = kept.mapInArrow(_count_batches, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # the sample bounds the stems that a thirtieth of its toxic texts share
    found = counts.where(_strong(toxic, clean)).collect() if toxic and clean else []
    stems = choose_stems([(r["stem"], r["t"], r["c"]) for r in found], toxic, clean)
    typical = float(np.median(list(stems.values()))) if stems else 4.0
    stems |= {s: typical for s in SEEDS if not any(s[:n] in stems for n in range(4, len(s) + 1))}
    model = spark.sparkContext.broadcast(pickle.dumps({"stems": stems}))
    seen = kept.mapInArrow(partial(_feature_batches, model=model), "toxic int, x1 double, x2 double").toPandas().sort_values(["toxic", "x1", "x2"])  # sums then do not depend on the order of tasks
    x, y = seen[["x1", "x2"]].to_numpy().reshape(-1, 2), seen["toxic"].to_numpy(dtype=float)
    # a little belief that a typical match is toxic and none is clean carries sizes without labels
    x, y = np.vstack([x, [[0, 0]] * 2, [[math.log1p(typical), math.log1p(typical)]] * 2]), np.r_[y, 0, 0, 1, 1]
    return {"stems": stems, "weights": logistic(x, y)}


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    fitted = pickle.loads(model.value)
    lexicon, w = Lexicon(fitted["stems"]), fitted["weights"]
    for batch in batches:
        z = w[0] + _features(lexicon, batch.column("text").to_pylist()) @ w[1:]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["id", "score"])


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row; null and empty texts have the score of a text without matches, repeated rows are scored alike."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_score_batches, model=spark.sparkContext.broadcast(pickle.dumps(model))), "id long, score double")
