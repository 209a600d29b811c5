"""Deterministic identifiers: a prefix and the first hex digits of a SHA-256 over parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def digest(*parts: Column, digits: int = 16) -> Column:
    """Null parts count as empty, so a missing part keeps its place."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *texts), 256), 1, digits)


def statement_id(account: Column, file_hash: Column) -> Column:
    return F.concat(F.lit("stmt_"), digest(account, file_hash))


def transaction_id(account: Column, statement: Column, day: Column, minor: Column, description: Column, ref: Column, locator: Column) -> Column:
    return F.concat(F.lit("txn_"), digest(account, statement, day, minor, description, ref, locator))


def fingerprint(account: Column, day: Column, minor: Column, description: Column, ref: Column) -> Column:
    return F.concat(F.lit("fp_"), digest(account, day, minor, description, ref))


def doubtful_fingerprint(statement: Column, locator: Column) -> Column:
    """For rows without a date or amount; the same on every run."""
    return F.concat(F.lit("fp_dudoso_"), digest(statement, locator, digits=8))


def import_id(*parts: Column) -> Column:
    return F.concat(F.lit("imp_"), digest(*parts, digits=12))
