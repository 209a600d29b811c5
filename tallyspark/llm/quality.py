"""Document quality by weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on every document.  The table of
vote patterns is aggregated over all documents (it cannot have more than
``3 ** len(RULES)`` rows), expectation-maximisation fits on it how often each
rule votes either way on good and on bad documents, and a document is kept when
its posterior probability of being good is high enough.  No rule has to pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .linededup import line_spans
from .runtime import durable, stored

WINDOW = 5
_SYMBOL = np.isin(A._ALL, np.frombuffer(b"#*$%&|<>", np.uint8))
_LEAD = (A._ALL & 0xC0) != 0x80
_UPPER = (A._ALL >= 65) & (A._ALL <= 90)
_LOW = (A._ALL >= 97) & (A._ALL <= 122)

#: Counts that a document is described by, in this order.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_echo", "n_bang", "n_marked", "n_closed")

#: name: (bad if, good if) over FEATURES; neither is an abstention.
RULES = {
    "word_length": ("word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 11 * n_words"),
    "symbols": ("n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    "marked_words": ("n_marked * 5 > n_words", "n_marked * 20 <= n_words"),
    "repeated_lines": ("n_lines >= 4 AND n_dup_lines * 10 > 3 * n_lines", "n_lines >= 4 AND n_dup_lines * 10 <= n_lines"),
    "repeated_words": ("n_repeat_words * 5 > n_words", "n_words >= 50 AND n_repeat_words * 20 <= n_words"),
    "echo": ("n_echo * 5 > n_words", "n_echo * 20 <= n_words"),
    "upper_case": ("n_upper > n_lower", "n_upper * 5 <= n_lower"),
    "shouting": ("n_bang * 5 > n_words", "n_bang * 20 <= n_words"),
    "sentences": ("n_words >= 30 AND n_closed = 0", "n_closed * 60 >= n_words"),
}


def _feature_kernel(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> dict:
    n = int(offsets[-1])
    text = buf[:n]
    starts, ends, bounds = A.spans(buf, offsets, A.IS_WORD)
    doc = A.doc_of(bounds)
    words = A.hash_spans(buf, starts, ends)
    in_doc = A.window_mask(bounds, WINDOW)
    at = np.flatnonzero(in_doc)
    marks = np.zeros(len(words), bool)
    marks[at] = A.repeated_in_doc(A.windows(words, WINDOW)[at], doc[at])
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    last, prior = buf[ends - 1], buf[np.maximum(ends - 2, 0)]
    closed = np.isin(last, np.frombuffer(b".!?", np.uint8))
    bang = (last == 0x21) & (prior == 0x21)
    symbol = np.zeros(n + 1, np.int64)
    np.cumsum(_SYMBOL[text], out=symbol[1:])
    marked = symbol[ends] > symbol[starts]
    ls, le, lb = line_spans(buf, offsets)
    filled = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    full = np.flatnonzero(filled)
    dup = np.zeros(len(ls), bool)
    dup[full] = A.repeated_in_doc(A.hash_spans(buf, ls[full], le[full]), A.doc_of(lb)[full], later_only=True)
    by_byte = lambda table: A.per_doc(table[text], offsets)
    return {
        "id": rows.column(0), "n_words": np.diff(bounds), "word_chars": by_byte(_LEAD & A.IS_WORD), "n_symbols": symbol[offsets[1:]] - symbol[offsets[:-1]],
        "n_dup_lines": A.per_doc(dup, lb), "n_repeat_words": A.per_doc(A.covered(marks, WINDOW), bounds), "n_lines": A.per_doc(filled, lb),
        "n_upper": by_byte(_UPPER), "n_lower": by_byte(_LOW), "n_echo": A.per_doc(echo, bounds), "n_bang": A.per_doc(bang, bounds),
        "n_marked": A.per_doc(marked, bounds), "n_closed": A.per_doc(closed, bounds), "rest": rows.column(2),
    }


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([("id", pa.int64()), *((f, pa.int64()) for f in FEATURES), ("rest", batch.schema.field(2).type)])
        yield from A.map_chunks([batch], "text", _feature_kernel, schema)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, prior_good: float = 0.85, rounds: int = 50, strength: float = 0.02) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how many documents have them.

    Returns the share of good documents and ``rates[class, rule, vote]`` with
    class 0 bad and 1 good, vote 0 bad, 1 abstain, 2 good.  ``strength`` is the
    weight, as a share of all documents, of the prior belief: good documents
    seldom get a bad vote, bad ones get many good votes from the rules that are
    about something else.  No rate is bounded: beyond the prior the votes decide.
    """
    total = max(float(counts.sum()), 1.0)
    prior = np.array([[0.3, 0.2, 0.5], [0.02, 0.18, 0.8]])
    n_rules = patterns.shape[1]
    rates = np.repeat(prior[:, None, :], n_rules, axis=1)
    share = prior_good
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        good = posterior(patterns, share, rates)
        share = float(np.clip((good * counts).sum() / total, 0.05, 0.99))
        for c, weight in ((0, (1 - good) * counts), (1, good * counts)):
            seen = np.einsum("p,prv->rv", weight, hot)
            base = prior[c] * (1 + strength * total)
            rates[c] = (seen + base) / (seen.sum(axis=1, keepdims=True) + base.sum())
    return share, rates


def posterior(patterns: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    """Probability of a good document for each pattern; abstentions carry no evidence."""
    logs = np.log(rates)
    at = patterns.astype(int) + 1
    voted = patterns != 0
    score = [sum(np.where(voted[:, r], logs[c, r, at[:, r]], 0.0) for r in range(patterns.shape[1])) for c in (0, 1)]
    odds = np.log(share) - np.log1p(-share) + score[1] - score[0]
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """Per row ``FEATURES``, ``base_failed``, ``posterior`` and ``kept``; with ``keep_columns`` also the text and the other columns in a struct ``rest``.

    Words are runs of non-white-space.  Null, empty and blank texts have no
    words and fail the base check.  Repeated rows are judged alike; an empty
    table gives no rows.  The vote statistics cover every row that passes the base
    check; the others are decided.
    """
    others = docs.columns if keep_columns else []
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest)
    from pyspark.sql import types as T

    out = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(f, T.LongType()) for f in FEATURES), rows.schema["rest"]])
    votes = [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(f"v{k}") for k, (bad, good) in enumerate(RULES.values())]
    measured = rows.mapInArrow(_feature_batches, out).select("*", *[F.when(F.col("n_words") > 0, v).otherwise(-1).alias(f"v{k}") for k, v in enumerate(votes)])
    # read twice, for the vote statistics and for the verdicts, but measured once
    measured = stored(measured) if keep_columns else durable(measured)
    names = [f"v{k}" for k in range(len(RULES))]
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > max_repeat_percent * F.col("n_words"))
    found = measured.where(~failed).groupBy(*names).count().collect()
    patterns = np.array([[r[c] for c in names] for r in found], dtype=np.int64).reshape(-1, len(RULES))
    share, rates = fit_votes(patterns, np.array([r["count"] for r in found], dtype=float))
    logs = np.log(rates)
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for k, c in enumerate(names):
        odds = odds + F.when(F.col(c) == 1, float(logs[1, k, 2] - logs[0, k, 2])).when(F.col(c) == -1, float(logs[1, k, 0] - logs[0, k, 0])).otherwise(0.0)
    scored = measured.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop(*names)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` keeps, with their columns."""
    scored = quality_scores(docs, id_col, text_col, keep_columns=True, **options)
    return scored.where("kept").select(*[F.col("rest")[c].alias(c) for c in docs.columns])
