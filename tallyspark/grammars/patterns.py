"""Layouts of issuers as Java regular expressions, built from a small grammar of tokens.

Tokens tell how digits, dates, amounts and signs are printed; ``says`` makes an
expression of wordings.  Layouts put tokens together.  Wordings are fixed values:
they are what issuers print, an accented letter standing for the plain one too.
"""

from __future__ import annotations

# --- tokens -----------------------------------------------------------------------

_ACCENTS = {"á": "[aá]", "é": "[eé]", "í": "[ií]", "ó": "[oó]", "ú": "[uú]"}
#: Letters in either case, accented ones included.
FLAGS = "(?iu)"


def digits(least: int, most: int | None = None) -> str:
    return f"[0-9]{{{least}}}" if most is None else f"[0-9]{{{least},{most}}}"


def letters(least: int, most: int | str = "") -> str:
    return rf"\p{{L}}{{{least},{most}}}"


def either(*forms: str) -> str:
    return f"(?:{'|'.join(forms)})"


def maybe(form: str) -> str:
    return f"(?:{form})?"


def keep(form: str) -> str:
    return f"({form})"


def starts(form: str) -> str:
    return f"^({form})"


def alone(form: str) -> str:
    return rf"^\s*{form}\s*$"


def wording(text: str) -> str:
    """A phrase whatever its spacing; punctuation stands for itself."""
    words = ("".join(_ACCENTS.get(c, c if c.isalnum() else "\\" + c) for c in word) for word in text.split())
    return r"\s+".join(words)


def says(*texts: str) -> str:
    return FLAGS + either(*map(wording, texts))


DAY, YEAR = digits(1, 2), digits(4)
ISO_DATE = "-".join((YEAR, digits(2), digits(2)))


def named_date(separator: str, month: str = letters(3) + r"\.?", year: str = YEAR) -> str:
    return DAY + separator + month + separator + year


def coded_date(separator: str) -> str:
    """Day, month as number or name, year."""
    return DAY + separator + "[A-Za-z0-9]{1,4}" + separator + digits(2, 4)


DECIMALS = r"\." + digits(2)
MAGNITUDE = "[0-9][0-9,]*" + DECIMALS
_DOLLAR = r"\$?\s?"
#: An amount in a column, perhaps in parentheses or with a hyphen.
AMOUNT = r"\(?-?" + _DOLLAR + MAGNITUDE + r"\)?"
#: An amount whose sign is printed: the sign, the magnitude.
SIGNED = keep("[-+]") + r"\s?" + _DOLLAR + keep(MAGNITUDE)
SIGNED_ALONE = alone(SIGNED)
_SUM = "[0-9,]+" + DECIMALS
#: A balance behind its label; the second form has the hyphen before the currency sign.
BALANCE = r"\$?\s*" + keep(r"-?\s?" + _SUM)
BALANCE_SIGN_FIRST = keep(r"-?\s?\$?\s?" + _SUM)

# --- dated lines --------------------------------------------------------------------

ANY_DATE = starts(either(ISO_DATE, coded_date("[/-]"), DAY + r"\s+" + letters(3) + r"\.?"))
_SPACED_DATE = named_date(r"[\s/]")
FULL_DATE = starts(either(_SPACED_DATE, ISO_DATE))
SECOND_DATE = r"^\s*" + _SPACED_DATE + r"\s+"
_SHORT_DATE = DAY + "/" + letters(3, 4) + maybe("/" + digits(2, 4))
DAY_MONTH = starts(_SHORT_DATE) + r"(?![\p{L}0-9_])"
SECOND_DAY_MONTH = r"^\s*" + keep(_SHORT_DATE) + r"\s+"
DAY_MONTH_PARTS = "^" + keep(DAY) + "/" + keep(letters(3, 4)) + maybe("/" + keep(digits(2, 4))) + "$"
CARD_DATE = starts(either(ISO_DATE, "/".join((DAY, DAY, digits(2, 4))), named_date(r"[\s/-]", year=digits(2, 4))))

# --- signed layouts -------------------------------------------------------------------

TABLE_HEADER = says("descripción del movimiento", "monto en pesos", "fecha de la operación", "fecha de cargo", "saldo anterior", "saldo al corte", "detalle de movimientos", "detalle de tus movimientos")
NOT_A_MOVEMENT = says("congelaste saldo", "descongelamos saldo")
TAX_SUFFIX = r"\s*\|\s*RFC:.*$"
_DAY_AND_MONTH = DAY + r"\s+" + keep(letters(3)) + r"\.?"
ONLY_DAY_MONTH = "^" + _DAY_AND_MONTH + "$"
DAY_MONTH_TEXT = "^" + keep(_DAY_AND_MONTH) + r"\s+(\S.*)$"
ONLY_YEAR = "^" + keep(YEAR) + "$"
YEAR_TEXT = "^" + keep(YEAR) + maybe(r"\s+(\S.*)") + "$"

# --- the older card layout of one issuer: date, text, hyphen, magnitude ------------------

LEGACY_LINE = "^" + keep(DAY + r"\s+" + letters(3, 4)) + r"\.?\s+(.*?)\s+(-\s?)?\$?" + keep(_SUM) + r"\s*$"
LEGACY_PAYMENT = says("pago a tu tarjeta")
LEGACY_AMBIGUOUS = says("devoluci", "reverso", "reversa", "bonificaci", "nota de crédito", "a favor", "cancelaci", "ajuste a favor")
_INSTALMENT = "[0-9]+" + maybe("[.,][0-9]+") + r"\s*%\s*[0-9]+\s*/\s*[0-9]+"
LEGACY_EXCLUDED = FLAGS + either(_INSTALMENT, wording("aumentaste tu límite"))
LEGACY_TOTAL = says("pagos a tu tarjeta en el periodo") + r"[^0-9\n]*" + keep(_SUM)

# --- debit accounts with a running balance here and there ---------------------------------

CREDIT_WORDS = says("recibid", "depósit", "abono", "reembols", "devolu", "interes a favor", "intereses a favor")
TABLE_END = FLAGS + r"^\s*" + either(*map(wording, ("total de movimientos", "total importe cargos", "total importe abonos")), wording("saldo final") + r"\b")
_FURNITURE_WORDS = ("libretón", "no. de cuenta", "no. de cliente", "la gat real")
_FURNITURE_TEXTS = ("bbva mexico, s.a.", "av. paseo de la reforma", "oper liq descripcion", "detalle de movimientos")
_FURNITURE_LINES = ("estado de cuenta", "fecha saldo")
PAGE_FURNITURE = FLAGS + r"^\s*" + either(
    *(wording(t) + r"\b" for t in _FURNITURE_WORDS), *map(wording, _FURNITURE_TEXTS), *(wording(t) + r"\s*$" for t in _FURNITURE_LINES), wording("pagina") + r"\s+[0-9]+\s*/"
)

# --- credit cards with two dates: both, text, sign, magnitude --------------------------------

CARD_LAYOUT = says("desglose de movimientos", "cargos, compras y abonos regulares")
_CARD_DAY = "-".join((DAY, letters(3, 3), YEAR))
CARD_LINE = "^" + keep(_CARD_DAY) + r"\s+" + keep(_CARD_DAY) + r"\s+(.+?)\s*([+-])\s*\$\s*" + keep(_SUM) + r"\s*$"
CARD_NUMBER = FLAGS + r"\s*;\s*" + keep(wording("tarjeta") + r"\s+\w+\s+\*+" + digits(4)) + r"\s*$"
CARD_DOLLARS = FLAGS + starts(r"USD\s*\$\s*" + _SUM + r"\s+" + wording("tipo de cambio") + r"\s+\$?\s*" + _SUM)

# --- day of month alone, thousands by spaces ---------------------------------------------------

LONE_DAY = r"^\s*" + keep(DAY) + r"\s+(?=\S{2,})"
SPACED_AMOUNT = r"\$\s*" + digits(1, 3) + "(?:[ ,]" + digits(3) + ")*" + DECIMALS

# --- charges of a revolving card -------------------------------------------------------------------

PAYMENT_WORDS = FLAGS + r"\b" + either(*map(wording, ("pago", "abono", "depósito", "crédito", "bonific", "reembols", "devoluc")))
LATE_FEE = says("pago tardío")

# --- lines of unknown issuers: date, text, amount ------------------------------------------------------

_LOOSE_DATE = either(coded_date(r"[/.\-]"), ISO_DATE, DAY + r"\s+" + letters(3) + r"\.?\s*" + digits(0, 4))
_LOOSE_AMOUNT = r"\(?-?" + _DOLLAR + r"[0-9,. ]*[0-9][0-9.,]*\)?"
GENERIC_LINE = r"^\s*" + keep(_LOOSE_DATE) + r"\s+(.+?)\s+" + keep(_LOOSE_AMOUNT) + r"\s*$"
GENERIC_DATED = _LOOSE_DATE
_LOOSE_BALANCE = keep(r"\(?[-+]?\$?\s?[0-9][0-9,.]*\)?")
GENERIC_OPENING = says("saldo inicial", "saldo anterior") + r"[^0-9]{0,15}" + _LOOSE_BALANCE
GENERIC_CLOSING = FLAGS + either(*map(wording, ("saldo final", "saldo actual", "saldo nuevo", "saldo al corte")), wording("saldo al generar") + r"[\p{L}\s]*?" + wording("estado") + r"[\p{L}\s]*?" + wording("cuenta")) + r"[^0-9]{0,3}" + _LOOSE_BALANCE

# --- periods: two dates, days of one month, cut-off date with a number of days, a whole month ---------

_PERIOD_DATE = either(DAY + r"[/\-.]\w{1,4}[/\-.]" + digits(2, 4), named_date(r"\s+"))
_PERIOD = wording("período") + ":?"
PERIOD_RANGE = FLAGS + either(wording("período"), wording("estado de cuenta")) + r":?\s+" + maybe(r"del\s+") + keep(_PERIOD_DATE) + r"\s+" + either("al", "[-–—]") + r"\s+" + keep(_PERIOD_DATE)
PERIOD_DAYS = FLAGS + _PERIOD + r"\s+del\s+" + keep(DAY) + r"\s+al\s+" + keep(DAY) + r"\s+" + keep(letters(3) + r"\.?") + r"\s+" + keep(YEAR)
CUT_DATE = FLAGS + wording("fecha de corte") + r":?\s+" + keep(named_date(r"\s+"))
DAY_COUNT = FLAGS + r"n[uú]m(?:ero)?\.?\s+" + wording("de días") + r"\s+" + either("del", r"en\s+el") + r"\s+" + _PERIOD + r"\s*" + keep(digits(1, 3))
PERIOD_MONTH = FLAGS + _PERIOD + r"\s+" + keep(letters(3) + r"\.?") + r"\s+" + keep(YEAR) + r"[^\n]{0,40}?" + wording("días del período") + r"\s+" + keep(digits(1, 2))

# --- summaries: opening and closing by issuer, first hit wins ------------------------------------------


def labelled(text: str, between: str = r"\s*", amount: str = BALANCE) -> str:
    return says(text) + between + amount


_NOTE = maybe(digits(1, 2) + r"\s+")
SUMMARY = {
    "nu": {
        "opening": (labelled("adeudo del periodo anterior", r"\s*=?\s*"), labelled("saldo inicial del periodo", r"\s*" + maybe(r"\([^)\n]{0,20}\)") + r"\s*:?\s*", BALANCE_SIGN_FIRST)),
        "closing": (
            labelled("saldo cargos regulares", r"\s*=?\s*"), labelled("saldo final del periodo", r"\s*:?\s*", BALANCE_SIGN_FIRST), labelled("saldo total del periodo", r"\s*:?\s*", BALANCE_SIGN_FIRST),
        ),
    },
    "uala": {"opening": (labelled("adeudo del periodo anterior"),), "closing": (labelled("pago para no generar intereses", r"[:\s¹²³⁴⁵⁶⁷⁸⁹⁰]*" + _NOTE),)},
    "vexi": {"opening": (labelled("saldo revolvente anterior"),), "closing": (labelled("saldo revolvente al corte"),)},
    "bbva": {"opening": (labelled("adeudo del periodo anterior"),), "closing": (labelled("saldo deudor total", r"[:\s]*" + _NOTE),)},
}
YIELD = FLAGS + keep(wording("dinero generado este mes")) + r"\s*" + BALANCE
CARD_STATEMENT = says("adeudo del periodo")
TOTAL_CREDITS = FLAGS + wording("depósitos") + r"\s*/\s*" + wording("abonos") + r"\s*\(\+\)\s*" + keep("[0-9]+") + r"\s+" + BALANCE
TOTAL_DEBITS = FLAGS + wording("retiros") + r"\s*/\s*" + wording("cargos") + r"\s*\(-\)\s*" + keep("[0-9]+") + r"\s+" + BALANCE
