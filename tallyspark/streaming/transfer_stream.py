"""Transfers between own accounts in a stream, each told once and only when no other candidate can come.

A state processor, keyed by amount and currency, keeps movements, not pairs, until
their days are out of reach of the watermark.  What makes the signal of a pair are
features that one end has and the other looks up, so an end that has two candidates
is known after two, however many there are: copies cost no pairs.  A pair whose
ends are in no other signalled pair when their windows have closed is a link.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import mentions_holder, mentions_token
from ..operators.transfers import CARD_PAYMENT, CARD_RECEIPT, CONFIDENCE, STOP_TOKENS, TRANSFER_WORDS, text_words
from .ledger_stream import LATENESS

_DAY_MS = 86_400_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A movement of one amount: ``said`` is an account whose token its text has, ``holder`` and ``card`` tell whether its text and kind of account can make those signals.
_MOVEMENT = "debit boolean, id string, account string, day int, ref string, said string, holder boolean, card boolean, to_card boolean"


class _Movement(NamedTuple):
    debit: bool
    id: str
    account: str
    day: int
    ref: str | None
    said: set[str]
    holder: bool
    card: bool
    to_card: bool


def movements(rows: DataFrame, tokens: DataFrame | None = None, holder: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Movements with ``size``, ``currency``, ``at`` and what the processor keeps; one row more for every token that the text has."""
    text = F.col("description_norm") if "description_norm" in rows.columns else F.lit(None).cast("string")
    card = F.coalesce(F.col("account_type").startswith("credito"), F.lit(False)) if "account_type" in rows.columns else F.lit(False)
    currency = F.coalesce("currency", F.lit("MXN")) if "currency" in rows.columns else F.lit("MXN")
    debit = F.col("amount_minor") < 0
    whole = rows.where("amount_minor <> 0 AND account_id IS NOT NULL AND date_op IS NOT NULL")
    # days of UTC, so that the watermark closes windows of whole days in any zone
    timed = whole.withColumn("at", F.timestamp_seconds(F.unix_date("date_op").cast("long") * 86_400)).withWatermark("at", lateness)
    paid, received = F.lower(text).rlike(CARD_PAYMENT), F.lower(text).rlike(CARD_RECEIPT)
    told = timed.select(
        F.abs("amount_minor").alias("size"), currency.alias("currency"), "at", debit.alias("debit"), F.col("transaction_id").cast("string").alias("id"), F.col("account_id").cast("string").alias("account"), F.unix_date("date_op").alias("day"),
        F.nullif(F.upper(F.trim("bank_ref")), F.lit("")).alias("ref"), text.alias("_text"), (mentions_holder(text, holder) if holder else F.lit(False)).alias("holder"),
        F.coalesce(F.when(debit, paid).otherwise(card & received), F.lit(False)).alias("card"), card.alias("to_card"),
    )
    if tokens is None:
        told = told.withColumn("said", F.lit(None).cast("string"))
    else:
        given = tokens.select(F.col("account_id").cast("string").alias("_said"), "token", F.split("token", " ")[0].alias("_word"))
        words = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(text_words(F.col("_text")), F.array().cast("array<string>")))
        met = told.withColumn("_word", F.explode(words)).join(given, "_word", "left")
        said = F.col("_said").isNotNull() & mentions_token(F.col("_text"), F.col("token"), STOP_TOKENS, 3, TRANSFER_WORDS)
        told = met.where(F.col("_word").isNull() | said).withColumnRenamed("_said", "said")
    return told.select("size", "currency", "at", "debit", "id", "account", "day", "ref", "said", "holder", "card", "to_card")


class SolePairs(StatefulProcessor):
    """Sends a pair when its window has closed and neither end has another one.

    A pair closes ``days`` after its later end: what could share an end with it has
    come by then.  A movement is kept three times as long, since it may be an end of
    the other candidates of pairs that close later.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("movements", _MOVEMENT)
        self.clock = handle.getValueState("clock", "due long, told long")  # the timer that is set, and up to where pairs were told

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["debit"], r["id"], r["account"], r["day"], r["ref"], r["said"], r["holder"], r["card"], r["to_card"]) for r in rows]
        self.held.appendList(new)
        due, told = self.clock.get() or (None, None)
        first = self._after(min(r[3] for r in new), 1)
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            self.clock.update((first, told))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        told = self.clock.get()[1]
        rows = [tuple(r) for r in self.held.get()]
        for d, c, signal in self._links(rows, told, now):
            yield Row(from_id=d.id, to_id=c.id, amount_minor=key[0], currency=key[1], signal=signal, confidence=CONFIDENCE[signal], kind="card_payment" if c.to_card else "transfer")
        kept = [r for r in rows if self._after(r[3], 3) > now]
        if not kept:
            self.held.clear()
            self.clock.clear()
            return
        if len(kept) < len(rows):
            self.held.put(kept)
        due = min(t for r in kept for n in (1, 2, 3) if (t := self._after(r[3], n)) > now)
        self.handle.registerTimer(due)
        self.clock.update((due, now))

    def close(self) -> None:
        pass

    def _after(self, day: int, windows: int) -> int:
        """The first millisecond of the watermark at which that many windows after a day are over."""
        return (day + windows * self.days) * _DAY_MS + 1

    def _links(self, rows: list[tuple], told: int | None, now: int) -> Iterator[tuple[_Movement, _Movement, str]]:
        ends: dict[tuple[bool, str], _Movement] = {}
        for r in rows:
            end = ends.setdefault(r[:2], _Movement(*r[:5], set(), *r[6:]))
            if r[5] is not None:
                end.said.add(r[5])
        debits, credits = (_Side(e for e in ends.values() if e.debit is debit) for debit in (True, False))
        for d in debits.ends:
            if self._after(d.day, 1) > now or told is not None and self._after(d.day, 2) <= told:
                continue  # none of its pairs closes now
            found = credits.partners(d, self.days)
            if len(found) != 1:
                continue
            c = ends[False, found.pop()]
            closes = self._after(max(d.day, c.day), 1)
            if closes <= now and (told is None or closes > told) and len(debits.partners(c, self.days)) == 1:
                yield d, c, _signal(d, c)


class _Side:
    """Debits or credits of one amount by the features that make a signal, then by day and account."""

    def __init__(self, ends: Iterator[_Movement]):
        self.ends = list(ends)
        self.by: dict[tuple, dict[int, dict[str, list[str]]]] = {}
        for e in self.ends:
            own = [("account", e.account), *(("said", a) for a in e.said)]
            own += [("ref", e.ref)] * (e.ref is not None) + [("card",)] * e.card + [("any",) if e.debit else ("holder",)] * (e.debit or e.holder)
            for f in own:
                self.by.setdefault(f, {}).setdefault(e.day, {}).setdefault(e.account, []).append(e.id)
        self.refs = sorted({e.ref for e in self.ends if e.ref is not None and len(e.ref) >= 6})

    def _wanted(self, e: _Movement) -> Iterator[tuple]:
        """Features that make a signal with a movement of the other side."""
        if e.ref is not None:
            yield "ref", e.ref
            yield from (("ref", e.ref[:n]) for n in range(6, len(e.ref)))
            k = bisect_left(self.refs, e.ref) if len(e.ref) >= 6 else len(self.refs)
            while k < len(self.refs) and self.refs[k].startswith(e.ref):
                yield "ref", self.refs[k]
                k += 1
        yield from (("account", a) for a in e.said)
        yield "said", e.account
        if e.debit:
            yield ("holder",)
        elif e.holder:
            yield ("any",)
        if e.card:
            yield ("card",)

    def partners(self, e: _Movement, days: int) -> set[str]:
        """Ids of the signalled partners of a movement of the other side: all of them if there are fewer than two, else two."""
        found: set[str] = set()
        for f in self._wanted(e):
            for day, accounts in self._near(f, e.day, days):
                for account, ids in accounts.items():
                    if account != e.account:
                        for i in ids:
                            found.add(i)
                            if len(found) > 1:
                                return found
        return found

    def _near(self, feature: tuple, day: int, days: int) -> Iterator[tuple[int, dict[str, list[str]]]]:
        by_day = self.by.get(feature, {})
        return ((x, by_day[x]) for x in range(day - days, day + days + 1) if x in by_day)


def _signal(d: _Movement, c: _Movement) -> str:
    """The first signal of a pair that has one."""
    x, y = d.ref or "", c.ref or ""
    if x and y and (x == y or min(len(x), len(y)) >= 6 and (x.startswith(y) or y.startswith(x))):
        return "bank_ref"
    if c.account in d.said or d.account in c.said:
        return "counterparty_token"
    return "titular" if c.holder else "pago_tarjeta"


def transfer_links(rows: DataFrame, tokens: DataFrame | None = None, holder: str | None = None, days: int = 3, lateness: str = LATENESS, crowded: DataFrame | None = None) -> DataFrame:
    """``(from_id, to_id, amount_minor, currency, signal, confidence, kind)`` in append mode, the links that the batch would make.

    ``crowded`` is a table of ``amount_minor`` that are too common to be linked (a
    stream can't know how common an amount will be).  Rows behind the watermark take
    no part.  State is kept in RocksDB, which the session is set to; a task holds the
    movements of one amount, within the watermark's reach, at a time.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    if crowded is not None:
        rows = rows.join(crowded.select(F.abs("amount_minor").alias("_crowded")).distinct(), F.abs("amount_minor") == F.col("_crowded"), "left_anti")
    told = movements(rows, tokens, holder, lateness)
    schema = "from_id string, to_id string, amount_minor long, currency string, signal string, confidence double, kind string"
    return told.groupBy("size", "currency").transformWithState(SolePairs(days), schema, "append", "eventTime")
