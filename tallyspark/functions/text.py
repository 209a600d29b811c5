"""Descriptions and merchants, and making untrusted text harmless."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Lower-case letters of other scripts that pass for Latin ones.
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "в": "b", "м": "m", "т": "t", "н": "h", "і": "i", "ѕ": "s",
    "ј": "j", "ԛ": "q", "ԝ": "w", "ё": "e", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "ε": "e", "ι": "i", "κ": "k", "χ": "x",
}
# Words that say nothing about a merchant, and labels whose value goes with them.
GENERIC_WORDS = ("mexico", "mx", "cdmx", "gdl", "mty", "compra", "pago", "tarjeta", "debito", "credito")
REFERENCE_LABELS = ("ref", "folio", "aut", r"autoriz\w*", r"no\.?", r"num\.?", "clave", "rfc")
REFERENCE = rf"(?U)\b(?:{'|'.join(REFERENCE_LABELS)})\b[#:\s]*[\-0-9a-z]+"
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def normalize_description(text: Column) -> Column:
    return F.coalesce(collapse_spaces(text), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; there is no built-in, so rows go through Arrow. ASCII text does not need it."""
    return _nfkc(text)


def composed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, ``text`` under compatibility composition; only texts beyond ASCII are handed to Python, nulls for the others."""
    return rows.withColumn(name, F.coalesce(_nfkc(F.when(~F.col(text).rlike(r"^[\x00-\x7F]*$"), F.col(text))), F.col(text)))


def normalize_merchant(text: Column, compose: bool = False) -> Column:
    """The merchant in lower case without references, long numbers and generic words; ``compose`` also folds compatibility forms."""
    s = nfkc(text) if compose else text
    s = F.lower(F.translate(s, "".join(CONFUSABLES), "".join(CONFUSABLES.values())))
    s = F.regexp_replace(s, REFERENCE, " ")
    s = F.regexp_replace(s, r"(?U)\b\d{6,}\b", " ")
    s = F.regexp_replace(s, "[*#]+", " ")
    s = F.regexp_replace(s, rf"(?U)\b({'|'.join(GENERIC_WORDS)})\b", " ")
    return F.coalesce(collapse_spaces(s), F.lit(""))


_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def csv_safe(text: Column) -> Column:
    """A quote before a cell that a spreadsheet would take for a formula."""
    return F.when(F.substring(text, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), text)).otherwise(text)


def untrusted(text: Column, limit: int = 120) -> Column:
    """One harmless line: no control characters, collapsed, no backticks, cut with an ellipsis."""
    s = F.translate(collapse_spaces(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")), "`", "'")
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def mask_account(name: Column, last4: Column) -> Column:
    return F.concat(name, F.lit(" (••••"), last4, F.lit(")"))


def mask_long_digits(text: Column) -> Column:
    """All but the last four of ten digits or more become an ellipsis."""
    return F.regexp_replace(text, r"[0-9]{6,}([0-9]{4})", "…$1")


def mentions_token(description: Column, token: Column, stop_words: tuple[str, ...] = (), short: int = 3, short_needs: str | None = None) -> Column:
    """Whether a text has the token as a whole word; short tokens may need another pattern as well."""
    hit = F.concat(F.lit(" "), F.regexp_replace(F.lower(description), r"(?U)\W+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), token, F.lit(" ")))
    ok = (F.length(token) >= 2) & ~token.isin(*stop_words) if stop_words else F.length(token) >= 2
    if short_needs:
        ok = ok & ((F.length(token) > short) | F.lower(description).rlike(short_needs))
    return hit & ok


def mentions_holder(description: Column, holder: str) -> Column:
    """Whether a text has the holder's full name, at least two words in sequence, whatever stands between them."""
    import re

    plain = "".join(c for c in unicodedata.normalize("NFD", holder or "") if unicodedata.category(c) != "Mn").lower()
    words = re.findall(r"\w+", plain)
    if len(words) < 2:
        return F.lit(False)
    return F.coalesce(fold(description).rlike(r"(?U)(?<!\w)" + r"\W+".join(words) + r"(?!\w)"), F.lit(False))


def harmless(value: object, keep_lines: bool = True) -> object:
    """Results for other programs, however nested: texts without control characters and backticks."""
    if isinstance(value, str):
        allowed = "\t\n\r" if keep_lines else ""
        return "".join("'" if c == "`" else c for c in value if c in allowed or (ord(c) >= 32 and ord(c) != 127))
    if isinstance(value, dict):
        return {harmless(k, keep_lines): harmless(v, keep_lines) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [harmless(v, keep_lines) for v in value]
    return value


def detail_fields(detail: Column) -> Column:
    """Concept, counterparty, reference and card of the lines, joined by ``|``, that an issuer prints below a movement; null where not printed.

    The concept stands between a seven-digit prefix, or ``BNET`` and an account,
    and ``Referencia``; the counterparty is the last line that is a name of two
    words or more; a reference has six digits or more; a card its last four.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(detail, F.lit("")), r" \| "), lambda x: F.trim(x)), lambda x: x != "")
    first = lambda rx: F.get(F.filter(F.transform(parts, lambda x: F.regexp_extract(x, rx, 1)), lambda x: x != ""), F.lit(0))
    name = r"^\p{L}+(?:\s+\p{L}+)+$"
    named = F.filter(parts, lambda x: x.rlike(name) & ~F.upper(x).startswith("RFC"))
    return F.struct(
        F.trim(first(r"^(?:[0-9]{7}|BNET\s+[0-9]+\s+)(.+?)\s+Referencia\b")).alias("concept"), F.get(named, F.size(named) - 1).alias("counterparty"),
        first(r"\bReferencia\s+([0-9]{6,})").alias("reference"), first(r"\*{4,}([0-9]{4})").alias("card"),
    )
