"""Named queries of the issuer grammars and of reading documents: movements are printed as an issuer would, and read back."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..grammars import issuers
from ..grammars.registry import LineGrammar, Movement, register_grammar
from ..operators import consolidated, duplicates, identify, transfers, validate
from ..session import bounded
from ..sources import statements
from .registry import query
from .views import DECLARED, TXN, declared, table, txn

_NAMES = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")
#: Opening balances are so high that none is overdrawn.
_OPENING = 100_000_000
MOVES = f"""{TXN}, m AS (SELECT *, row_number() OVER s AS k, abs(amount_minor) AS size, format('{{:,}}', abs(amount_minor) // 100) || '.' || lpad(CAST(abs(amount_minor) % 100 AS VARCHAR), 2, '0') AS shown,
  CAST({_OPENING} + sum(amount_minor) OVER s AS BIGINT) AS balance FROM txn WINDOW s AS (PARTITION BY statement_id ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING))"""


def _amount(minor: Column) -> Column:
    return F.concat(F.format_number(F.floor(minor / 100), 0), F.lit("."), F.lpad((minor % 100).cast("string"), 2, "0"))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` with a number in its statement, its amount, sign, day and month as printed, and the balance after it."""
    order = Window.partitionBy("statement_id").orderBy("ts", "transaction_id")
    rows = bounded(txn(spark, sf_dir), "statement_id").withColumn("k", F.row_number().over(order).cast("long")).withColumn("size", F.abs("amount_minor"))
    balance = _OPENING + F.sum("amount_minor").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({
        "shown": _amount(F.col("size")), "sign": F.when(F.col("amount_minor") < 0, "-").otherwise("+"), "dd": F.date_format("date_op", "dd"), "yyyy": F.date_format("date_op", "yyyy"),
        "mon": F.element_at(F.array(*map(F.lit, _NAMES)), F.month("date_op")), "balance": balance, "due": _amount(balance),
    })


def _say(*parts: str | Column) -> Column:
    """Texts, and columns by ``{name}``."""
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p)
            continue
        for i, piece in enumerate(p.replace("}", "{").split("{")):
            out.append(F.col(piece).cast("string") if i % 2 else F.lit(piece))
    return F.concat(*out)


def _lines(rows: DataFrame, *lines: Column) -> DataFrame:
    """Up to ten lines of each movement, numbered by it; null lines are not printed."""
    said = rows.select(F.col("statement_id").alias("doc_id"), "k", F.posexplode(F.array(*lines)).alias("p", "line")).where("line IS NOT NULL")
    return said.select("doc_id", (F.col("k") * 10 + F.col("p")).cast("int").alias("line_no"), "line")


def _docs(rows: DataFrame, bank: Column | str, said: Column | str = "") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    docs = rows.groupBy(F.col("statement_id").alias("doc_id")).agg(F.min("date_op").alias("period_start"), F.max("date_op").alias("period_end"), (F.lit(_OPENING) + F.sum("amount_minor")).cast("long").alias("closing_minor"))
    return docs.withColumn("opening_minor", F.lit(_OPENING).cast("long")).withColumn("bank", lit(bank)).withColumn("text", lit(said))


def _told(found: DataFrame, *columns: str) -> DataFrame:
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), *columns)


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 + CASE WHEN k % 5 IN (2, 3) THEN 1 ELSE 0 END AS line_no, date_op,
  CASE k % 5 WHEN 0 THEN 'compra ' WHEN 1 THEN 'pago ' WHEN 2 THEN 'cafe ' ELSE 'texto suelto ' END || k AS description, amount_minor FROM m WHERE k % 5 <> 4""")
def grammar_signed(spark, sf_dir):
    rows, k = _moves(spark, sf_dir), F.col("k") % 5
    first = (
        F.when(k == 0, _say("{dd} {mon} {yyyy} compra {k} {sign}${shown}")).when(k == 1, _say("{dd} {mon} {yyyy} {dd} {mon} {yyyy} pago {k} | RFC: ABC010101 {sign} ${shown}")).when(k == 2, _say("{sign} ${shown}"))
        .when(k == 3, _say("texto suelto {k}")).otherwise(_say("{dd} {mon} {yyyy} Congelaste saldo {sign}${shown}"))
    )
    second = F.when(k == 2, _say("{dd}/{mon}/{yyyy} cafe {k}")).when(k == 3, _say(F.date_format("date_op", "yyyy-MM-dd"), " {sign}${shown}"))
    return _told(issuers.signed(_lines(rows, first, second)), "date_op", "description", "amount_minor")


class TwoLines(LineGrammar):
    """A grammar as a user writes one: ``>> day text`` and an amount on the next line; a day without an amount is a warning, the last sum is compared."""

    def line(self, row):
        text = row["line"]
        if text.startswith(">> "):
            yield from self.end()
            day, _, said = text[3:].partition(" ")
            self.state = {"line": row["line_no"], "day": day, "said": said}
        elif self.state and (m := re.fullmatch(r"([+-]?)\$?([0-9,]+)\.([0-9]{2})", text.strip())):
            cents = int(m[2].replace(",", "") + m[3])
            day, at = self.state["day"], self.state["line"]
            yield Movement(at, day, dt.date.fromisoformat(day), description=self.state["said"], amount_minor=-cents if m[1] == "-" else cents)
            self.state = {}

    def end(self):
        if self.state:
            yield Movement(self.state["line"], warning="a day without an amount")
            self.state = {}


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 AS line_no, CASE WHEN k % 7 <> 3 THEN strftime(date_op, '%Y-%m-%d') END AS day, CASE WHEN k % 7 <> 3 THEN 'movimiento ' || k END AS description,
  CASE WHEN k % 7 <> 3 THEN amount_minor END AS amount_minor, CASE WHEN k % 7 = 3 THEN 'a day without an amount' END AS warning FROM m""")
def registered_grammar(spark, sf_dir):
    """Documents of an issuer whose grammar was registered; every seventh movement lacks its amount."""
    rows, k = _moves(spark, sf_dir), F.col("k") % 7
    lines = _lines(rows, _say(">> ", F.date_format("date_op", "yyyy-MM-dd"), " movimiento {k}"), F.when(k != 3, _say("{sign}${shown}")))
    docs = _docs(rows, "dosrenglones")
    grammars = {"dosrenglones": register_grammar(spark, "dosrenglones", TwoLines)}
    read = issuers.read_lines(lines, docs, grammars).withColumn("day", F.date_format("date_op", "yyyy-MM-dd"))
    return _told(read, "day", "description", "amount_minor", "warning")


_SPLIT = """CASE WHEN amount_minor < 0 THEN '-' ELSE '+' END || '$' || shown"""
_DM = "strftime(date_op, '%d') || ' ' || " + str(list(_NAMES)) + "[month(date_op)]"


@query(f"""WITH {MOVES}
SELECT statement_id AS doc_id, k * 10 AS line_no, {_DM} || ' ' || year(date_op) || CASE k % 3 WHEN 0 THEN ' Persona ' || k || ' Sin concepto ' ELSE ' Persona ' || k || ' Transferencia de Nomina ' END || {_SPLIT} AS line FROM m WHERE k % 3 <> 2
UNION ALL SELECT statement_id, k * 10 + i, CASE i WHEN 0 THEN '12 ABONOS' WHEN 1 THEN 'algo +$1.00' ELSE '2026' END FROM m, (VALUES (0), (1), (2)) v(i) WHERE k % 3 = 2""")
def grammar_split_dates(spark, sf_dir):
    rows, k = _moves(spark, sf_dir), F.col("k") % 3
    lines = _lines(
        rows, F.when(k == 0, _say("{dd} {mon}")).when(k == 1, _say("{dd} {mon} Persona {k} Transferencia de")).otherwise("12 ABONOS"),
        F.when(k == 0, _say("Persona {k} Sin concepto {sign}${shown}")).when(k == 1, _say("{sign}${shown}")).otherwise("algo +$1.00"), F.when(k == 0, F.col("yyyy")).when(k == 1, _say("{yyyy} Nomina")).otherwise("2026"),
    )
    return _told(issuers.rejoin_split_dates(lines), "line")


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 AS line_no, date_op, CASE WHEN k % 6 IN (1, 2) THEN -size ELSE size END AS amount_minor, k % 6 = 3 OR statement_id % 4 = 0 AS doubtful FROM m WHERE k % 6 < 4""")
def grammar_legacy_card(spark, sf_dir):
    rows, k = _moves(spark, sf_dir), F.col("k") % 6
    line = (
        F.when(k == 0, _say("{dd} {mon} Super {k} ${shown}")).when(k == 1, _say("{dd} {mon}. Pago a tu tarjeta {shown}")).when(k == 2, _say("{dd} {mon} Reversión parcial - ${shown}")).when(k == 3, _say("{dd} {mon} Devolución {k} {shown}"))
        .when(k == 4, _say("{dd} {mon} Compra {k} ${shown} 0% 3/12 $1.00")).otherwise(_say("{dd} {mon} Aumentaste tu límite ${shown}"))
    )
    paid = rows.groupBy("statement_id").agg(F.sum(F.when(k == 1, F.col("size")).otherwise(0)).alias("paid")).withColumn("paid", F.col("paid") + F.when(F.col("statement_id") % 4 == 0, 1).otherwise(0))
    told = paid.select(F.col("statement_id").alias("doc_id"), F.when(F.col("statement_id") % 2 == 0, F.concat(F.lit("Pagos a tu tarjeta en el periodo: $"), _amount(F.col("paid")))).otherwise("").alias("text"))
    docs = _docs(rows, "nu").drop("text").join(told, "doc_id")
    return _told(issuers.legacy_card(_lines(rows, line), docs), "date_op", "amount_minor", "doubtful")


@query(f"""WITH {MOVES}, p AS (SELECT *, coalesce(lag(balance) OVER (PARTITION BY statement_id ORDER BY k), {_OPENING}) AS before FROM m)
SELECT statement_id AS doc_id, k * 10 AS line_no, date_op, 'linea ' || k AS description, CASE WHEN amount_minor < 0 THEN -1 ELSE 1 END * (size + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS amount_minor, balance AS balance_minor, k % 9 = 0 AS doubtful FROM p""")
def grammar_balance_column(spark, sf_dir):
    rows = _moves(spark, sf_dir)
    printed = _amount(F.col("size") + F.when(F.col("k") % 9 == 0, 1).otherwise(0))
    lines = _lines(rows, _say(F.date_format("date_op", "dd/MM/yyyy"), " linea {k} ", printed, " {due}"), _say("Rendimiento del 01/06/2026 {shown} {due}"))
    return _told(issuers.balance_column(lines, _docs(rows, "gbm")), "date_op", "description", "amount_minor", "balance_minor", "doubtful")


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 AS line_no, date_op, date_op AS date_post, CASE WHEN amount_minor < 0 THEN 'SPEI ENVIADO ' ELSE 'SPEI RECIBIDO ' END || k AS description,
  CASE WHEN k % 3 = 1 THEN 'RFC ' || k || ' | concepto' ELSE '' END AS detail, amount_minor, CASE WHEN k % 2 = 0 THEN balance END AS balance_minor, false AS doubtful FROM m""")
def grammar_segments(spark, sf_dir):
    rows, k = _moves(spark, sf_dir), F.col("k")
    said = F.when(F.col("amount_minor") < 0, "SPEI ENVIADO ").otherwise("SPEI RECIBIDO ")
    lines = _lines(
        rows, _say("{dd}/{mon} {dd}/{mon} ", said, "{k} {shown}", F.when(k % 2 == 0, _say(" {due} {due}")).otherwise("")), F.when(k % 3 == 1, _say("RFC {k}")), F.when(k % 3 == 1, F.lit("Pagina 1 / 2")), F.when(k % 3 == 1, F.lit("concepto")),
        F.when(k % 3 == 2, F.lit("TOTAL DE MOVIMIENTOS")), F.when(k % 3 == 2, F.lit("no es detalle")),
    )
    return _told(issuers.segments(lines, _docs(rows, "bbva")), "date_op", "date_post", "description", "detail", "amount_minor", "balance_minor", "doubtful")


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 AS line_no, date_op, date_op AS date_post, 'TIENDA ' || k AS description,
  CASE WHEN k % 2 = 0 THEN 'Tarjeta Digital ***1234' ELSE '' END || CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN ' | ' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'USD $1.00 TIPO DE CAMBIO $17.71' ELSE '' END AS detail, amount_minor FROM m""")
def grammar_card_two_dates(spark, sf_dir):
    rows, k = _moves(spark, sf_dir), F.col("k")
    day = _say("{dd}-", F.lower("mon"), "-{yyyy}")
    card = F.when(k % 2 == 0, " ; Tarjeta Digital ***1234").otherwise("")
    lines = _lines(rows, F.concat(day, F.lit(" "), day, _say(" TIENDA {k}"), card, _say(" {sign} ${shown}")), F.when(k % 3 == 0, F.lit("USD $1.00 TIPO DE CAMBIO $17.71")))
    return _told(issuers.two_dates(lines), "date_op", "date_post", "description", "detail", "amount_minor")


@query(f"""WITH {MOVES}, d AS (SELECT statement_id, min(date_op) AS a, max(date_op) AS b FROM m GROUP BY 1)
SELECT statement_id AS doc_id, k * 10 AS line_no, CASE WHEN (SELECT count(*) FROM generate_series(a, b, INTERVAL 1 DAY) g(x) WHERE day(x) = day(date_op)) = 1 THEN date_op END AS date_op, 'SPEI ' || k || ' 123456' AS description, amount_minor, balance AS balance_minor, false AS doubtful
FROM m JOIN d USING (statement_id)""")
def grammar_day_column(spark, sf_dir):
    rows = _moves(spark, sf_dir)
    spaced = lambda c: F.replace(F.col(c), F.lit(","), F.lit(" "))
    lines = _lines(rows, _say("{dd} SPEI {k} 123456 $ ", spaced("shown"), " $ ", spaced("due")), _say("{dd} sin par $ 5.00"))
    return _told(issuers.day_column(lines, _docs(rows, "hsbc")), "date_op", "description", "amount_minor", "balance_minor", "doubtful")


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 AS line_no, date_op, CASE k % 4 WHEN 0 THEN 'Cafe' WHEN 1 THEN 'Su pago recibido' WHEN 2 THEN 'Comisión por pago tardío' ELSE 'Ajuste' END AS description,
  CASE WHEN k % 4 IN (1, 3) THEN -size ELSE size END AS amount_minor FROM m""")
def grammar_charges(spark, sf_dir):
    rows, k = _moves(spark, sf_dir), F.col("k") % 4
    said = F.when(k == 0, _say("Cafe ${shown}")).when(k == 1, _say("Su pago recibido ${shown}")).when(k == 2, _say("Comisión por pago tardío ${shown}")).otherwise(_say("Ajuste ({shown})"))
    lines = _lines(rows, _say(F.date_format("date_op", "dd/MM/yyyy"), " ", said), _say("Pago mínimo {dd}/01/2026 ${shown}"))
    return _told(issuers.charges(lines), "date_op", "description", "amount_minor")


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 AS line_no, date_op, 'concepto ' || k || ' x' AS description, CASE WHEN k % 5 = 4 THEN NULL ELSE amount_minor END AS amount_minor FROM m""")
def grammar_generic(spark, sf_dir):
    rows, k = _moves(spark, sf_dir), F.col("k") % 5
    iso, euro = F.date_format("date_op", "yyyy-MM-dd"), F.translate("shown", ".,", ",.")
    minus = F.when(F.col("amount_minor") < 0, "-").otherwise("")
    line = (
        F.when(k == 0, _say(iso, " concepto {k} x ", minus, "${shown}")).when(k == 1, _say("  {dd} {mon} {yyyy}  concepto {k} x  ", minus, "{shown} ")).when(k == 2, _say(F.date_format("date_op", "dd/MM/yyyy"), " concepto {k} x ", minus, euro))
        .when(k == 3, _say(F.date_format("date_op", "dd-MM-yy"), " concepto {k} x ", F.when(F.col("amount_minor") < 0, _say("({shown})")).otherwise(F.col("shown")))).otherwise(_say(iso, " concepto {k} x 5.000"))
    )
    return _told(issuers.generic(_lines(rows, line, _say(iso, " sin importe"))), "date_op", "description", "amount_minor")


_ISSUERS = ("nu", "uala", "gbm", "hsbc", "vexi", "bbva")


@query(f"""WITH {MOVES} SELECT statement_id AS doc_id, k * 10 AS line_no, date_op, CASE WHEN statement_id % 7 = 4 THEN size ELSE amount_minor END AS amount_minor, false AS doubtful FROM m""")
def grammar_dispatch(spark, sf_dir):
    rows = _moves(spark, sf_dir)
    which = F.col("statement_id") % 7
    bank = F.get(F.array(*map(F.lit, _ISSUERS)), (F.col("doc_id") % 7).cast("int"))
    day = F.date_format("date_op", "dd/MM/yyyy")
    minus = F.when(F.col("amount_minor") < 0, "-").otherwise("")
    line = (
        F.when(which < 2, _say("{dd} {mon} {yyyy} algo {sign}${shown}")).when(which == 2, _say(day, " algo {shown} {due}")).when(which == 3, _say("{dd} algo ${shown} ${due}")).when(which == 4, _say(day, " algo ${shown}"))
        .when(which == 5, _say("{dd}/{mon} {dd}/{mon} algo {shown} {due} {due}")).otherwise(_say(day, " algo ", minus, "{shown}"))
    )
    return _told(issuers.parse_lines(_lines(rows, line), _docs(rows, bank)), "date_op", "amount_minor", "doubtful")


@query(f"""WITH {MOVES}
SELECT statement_id AS doc_id, k * 10 + i AS line_no, CASE i WHEN 0 THEN 'excluded by its label' ELSE 'amount taken from the line before' END AS warning FROM m, (VALUES (0), (2)) v(i) WHERE statement_id % 3 = 0
UNION ALL SELECT statement_id, k * 10, 'dated line without amount and balance' FROM m WHERE statement_id % 3 = 1
UNION ALL SELECT statement_id, k * 10, 'dated line not understood' FROM m WHERE statement_id % 3 = 2""")
def grammar_warnings(spark, sf_dir):
    rows, which = _moves(spark, sf_dir), F.col("statement_id") % 3
    day = F.date_format("date_op", "dd/MM/yyyy")
    lines = _lines(
        rows, F.when(which == 0, _say("{dd} {mon} {yyyy} Descongelamos saldo {sign}${shown}")).when(which == 1, _say(day, " solo {shown}")).otherwise(_say(day, " sin importe")),
        F.when(which == 0, _say("{sign} ${shown}")).when(which == 1, _say(day, " algo {shown} {due}")).otherwise(_say(day, " algo {shown}")), F.when(which == 0, _say("{dd} {mon} {yyyy} cafe")),
    )
    bank = F.when(F.col("doc_id") % 3 == 0, "uala").when(F.col("doc_id") % 3 == 1, "gbm")
    return _told(issuers.warnings(lines, _docs(rows, bank)), "warning")


_CENTS = "CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * 100) AS BIGINT)"


def _summaries(spark, sf_dir):
    """Summaries of four issuers and of none; a negative balance has its hyphen before the currency sign."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.round(F.col("c_acctbal").cast("decimal(18,2)") * 100).cast("long").alias("m"))
    k, owed = F.col("doc_id") % 5, _amount(F.abs("m"))
    minus = F.when(F.col("m") < 0, "- ").otherwise("")
    said = (
        F.when(k == 0, F.concat(F.lit("Saldo inicial del periodo (ENE 2026): "), minus, F.lit("$"), owed, F.lit("\nSaldo total del periodo $1.00\nDinero generado este mes $"), owed)).when(k == 1, F.concat(F.lit("Adeudo del periodo anterior $"), owed, F.lit(" Pago para no generar intereses2 $2.00")))
        .when(k == 2, F.concat(F.lit("Saldo revolvente anterior $3.00 saldo  revolvente al corte $"), owed)).when(k == 3, F.concat(F.lit("Depósitos / Abonos (+) 3 "), owed, F.lit(" Retiros / Cargos (-) "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2 "), owed)).otherwise("")))
        .otherwise(F.concat(F.lit("Saldo inicial $"), owed, F.lit(" y saldo al corte: $4.00")))
    )
    bank = F.when(k == 0, "nu").when(k == 1, "uala").when(k == 2, "vexi").when(k == 3, "bbva")
    return c.select("doc_id", bank.alias("bank"), said.alias("text"), F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("doc_id") % 30).cast("int")).alias("period_end"), "m")


@query(f"""SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN {_CENTS} WHEN 1 THEN abs({_CENTS}) WHEN 2 THEN 300 END AS summary_opening, CASE c_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN abs({_CENTS}) END AS summary_closing FROM customer""")
def summary_balances(spark, sf_dir):
    return issuers.summaries(_summaries(spark, sf_dir)).select("doc_id", "summary_opening", "summary_closing")


@query(f"""SELECT c_custkey AS doc_id, abs({_CENTS}) AS declared_credits, CASE WHEN c_custkey % 2 = 0 THEN -abs({_CENTS}) END AS declared_debits, CASE WHEN c_custkey % 2 = 0 THEN CAST(5 AS BIGINT) END AS declared_count FROM customer WHERE c_custkey % 5 = 3""")
def summary_declared_totals(spark, sf_dir):
    return issuers.summaries(_summaries(spark, sf_dir)).where("declared_credits IS NOT NULL").select("doc_id", "declared_credits", "declared_debits", "declared_count")


@query(f"""SELECT c_custkey AS doc_id, DATE '2026-01-01' + CAST(c_custkey % 30 AS INT) AS date_op, abs({_CENTS}) AS amount_minor FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 0 AND {_CENTS} <> 0""")
def summary_yield(spark, sf_dir):
    docs = _summaries(spark, sf_dir)
    listed = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("Dinero generado en enero").alias("description"))
    return issuers.summary_rows(docs, listed).select("doc_id", "date_op", "amount_minor")


@query("""SELECT c_custkey AS doc_id, format('{:,}', a // 100) || '.' || lpad(CAST(a % 100 AS VARCHAR), 2, '0') AS opening_raw, '4.00' AS closing_raw
FROM (SELECT c_custkey, abs(CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * 100) AS BIGINT)) AS a FROM customer WHERE c_custkey % 5 = 4)""")
def summary_generic(spark, sf_dir):
    return issuers.generic_balances(_summaries(spark, sf_dir).where("bank IS NULL")).select("doc_id", "opening_raw", "closing_raw")


# --- reading documents ------------------------------------------------------------------------------


def _files(spark, sf_dir):
    """A CSV file of each statement of ``txn``, as the source would list it."""
    rows = _moves(spark, sf_dir)
    minus = F.when(F.col("amount_minor") < 0, "-").otherwise("")
    line = _say(F.date_format("date_op", "yyyy-MM-dd"), ',"', "concepto, {k}", '",', minus, F.replace("shown", F.lit(","), F.lit("")), F.when(F.col("k") % 4 == 0, F.lit("\n ,,")).otherwise(""))
    body = rows.groupBy("statement_id", "account_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    whole = F.concat(F.lit("# account_id: "), F.col("account_id").cast("string"), F.lit("\nFecha,Concepto,Importe\n"), F.col("body"), F.lit("\n# currency: MXN\n"))
    return body.select(F.concat(F.lit("/inbox/"), F.col("statement_id").cast("string"), F.lit(".csv")).alias("path"), F.lit("csv").alias("ext"), F.encode(whole, "UTF-8").alias("content")).withColumn("file_sha256", F.sha2("content", 256))


@query(f"""WITH {MOVES} SELECT '/inbox/' || statement_id || '.csv' AS path, CAST(account_id AS VARCHAR) AS account_id, 'row:' || (k + k // 4 - CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) AS locator, strftime(date_op, '%Y-%m-%d') AS date_op, 'concepto, ' || k AS description,
  CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || replace(shown, ',', '') AS amount FROM m""")
def read_csv_statements(spark, sf_dir):
    read = statements.read_statements(_files(spark, sf_dir))
    return read.select("path", F.col("meta")["account_id"].alias("account_id"), F.explode("rows").alias("r")).select("path", "account_id", "r.locator", "r.date_op", "r.description", "r.amount")


@query(f"""WITH {TXN} SELECT DISTINCT '/inbox/' || statement_id || CASE WHEN statement_id % 2 = 0 THEN '.csv' ELSE '.xlsx' END AS path, CASE WHEN statement_id % 2 = 0 THEN 'csv' ELSE 'unreadable:xlsx' END AS method, statement_id % 2 = 1 AS warned FROM txn""")
def dispatch_files(spark, sf_dir):
    """Every other file claims to be a workbook and is none."""
    odd = F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 2 == 1
    files = _files(spark, sf_dir).withColumn("ext", F.when(odd, "xlsx").otherwise("csv")).withColumn("path", F.when(odd, F.replace("path", F.lit(".csv"), F.lit(".xlsx"))).otherwise(F.col("path")))
    return statements.read_statements(files).select("path", "method", (F.size("warnings") > 0).alias("warned"))


@query("SELECT doc_id, length(trim(coalesce(text, ''))) >= 500 AND NOT regexp_matches(coalesce(text, ''), '[0-9][0-9,]*\\.[0-9]{2}') AS unusable FROM documents")
def unusable_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", statements.unusable_text(F.coalesce("text", F.lit(""))).alias("unusable"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' $' || p_partkey || '.25' END AS line, p_partkey % 3 <> 0 AS good FROM part")
def decode_mainframe(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" $"), F.col("p_partkey").cast("string"), F.lit(".25")))

    @F.pandas_udf("binary")
    def punched(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: x.encode("cp037"))

    rows = table(spark, sf_dir, "part").select("p_partkey", punched(said).alias("bytes"))
    return rows.select("p_partkey", statements.ebcdic(F.col("bytes")).alias("d")).select("p_partkey", "d.line", "d.good")


@query("SELECT o_orderkey AS page, CAST(0 AS BIGINT) AS line_no, 'SALDO' || CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '   ' ELSE '' END || o_orderkey || '.25' AS line FROM orders WHERE o_orderkey % 7 = 0")
def glyph_lines(spark, sf_dir):
    """Glyphs of a mainframe document: half of them by their code, the others by the character that the code has in the font's table."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select("o_orderkey", F.concat(F.lit("SALDO"), F.col("o_orderkey").cast("string"), F.lit(".25")).alias("said"))
    gap = F.when(F.col("o_orderkey") % 3 == 0, 5.0).when(F.col("o_orderkey") % 3 == 1, 300.0).otherwise(0.0)
    glyphs = o.select("o_orderkey", gap.alias("gap"), F.posexplode(F.split("said", "")).alias("at", "c")).where("c <> ''")

    @F.pandas_udf("string")
    def coded(chars: pd.Series) -> pd.Series:
        return chars.map(lambda c: f"(cid:{c.encode('cp037')[0]})")

    x = F.col("at") * 5.0 + F.when(F.col("at") >= 5, F.col("gap")).otherwise(0.0)
    words = glyphs.select(F.col("o_orderkey").alias("page"), F.lit(0.4).alias("top"), x.alias("x0"), (x + 5.0).alias("x1"), coded("c").alias("text"))
    return statements.glyph_lines(words).select("page", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""SELECT l_orderkey AS page, 'w' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS word FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 'alone' FROM lineitem""")
def watermark_removed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.concat(F.lit("w"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("text"))
    body = rows.select("page", (F.col("l_linenumber") * 30.0).alias("top"), F.lit(0.0).alias("x0"), F.lit(50.0).alias("x1"), F.lit("body").alias("font"), "text")
    mark = rows.where("l_linenumber = 1").select("page", F.lit(30.5).alias("top"), F.lit(40.0).alias("x0"), F.lit(90.0).alias("x1"), F.lit("mark").alias("font"), F.lit("WATER").alias("text")).distinct()
    single = rows.select("page", F.lit(3000.0).alias("top"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("x1"), F.lit("mark").alias("font"), F.lit("alone").alias("text")).distinct()
    more = body.withColumn("text", F.lit(None).cast("string")).withColumn("top", F.col("top") + 15)  # the body's font is the page's
    return statements.without_overlay(body.unionByName(mark).unionByName(single).unionByName(more)).where("text IS NOT NULL").select("page", F.col("text").alias("word"))


def _ocr(spark, sf_dir):
    rows = _moves(spark, sf_dir)
    k = F.col("k")
    line = lambda due: F.when(k % 4 == 3, "ruido").otherwise(_say("{dd}/01/24 cafe {k} {shown} ", due))
    base = lambda due, confidence: rows.select(F.col("statement_id").alias("doc_id"), F.col("k").alias("line_no"), line(due).alias("line"), confidence.alias("confidence"))
    first = base(F.col("due"), F.when(k % 8 == 3, 30).otherwise(80))
    second = base(F.when(k % 5 == 0, F.lit("9.99")).otherwise(F.col("due")), F.lit(70))
    return first, second


_DOUBT = """(SELECT *, CASE WHEN k % 4 = 3 THEN k % 8 = 3 ELSE NOT EXISTS (SELECT 1 FROM m b WHERE b.statement_id = a.statement_id AND b.k % 4 <> 3 AND b.date_op = a.date_op AND b.shown = a.shown
  AND CASE WHEN b.k % 5 = 0 THEN 999 ELSE b.balance END = a.balance) END AS doubtful FROM m a)"""


@query(f"WITH {MOVES} SELECT statement_id AS doc_id, k AS line_no, doubtful FROM {_DOUBT}")
def ocr_cross_check(spark, sf_dir):
    first, second = _ocr(spark, sf_dir)
    return statements.cross_check_ocr(first, second).select("doc_id", "line_no", "doubtful")


@query(f"WITH {MOVES}, d AS {_DOUBT} SELECT statement_id AS doc_id, k AS line_no, k % 4 <> 3 AND EXISTS (SELECT 1 FROM d b WHERE b.doubtful AND b.k % 4 <> 3 AND b.statement_id = a.statement_id AND b.shown = a.shown AND b.balance = a.balance) AS doubtful FROM d a")
def ocr_flagged_rows(spark, sf_dir):
    first, second = _ocr(spark, sf_dir)
    rows = first.select("doc_id", "line_no", F.col("line").alias("raw_text"), F.lit(False).alias("doubtful"))
    return statements.flag_rows_of_doubtful_lines(rows, statements.cross_check_ocr(first, second)).select("doc_id", "line_no", "doubtful")


@query("""SELECT o_orderkey AS page, CAST(min(c) AS BIGINT) AS confidence, CAST(round(avg(c), 6) AS DOUBLE) AS mean, arg_min(font, struct_pack(n := -n, f := font)) AS font FROM (
  SELECT o_orderkey, l_linenumber * 7 % 90 AS c, l_returnflag AS font, count(*) OVER (PARTITION BY o_orderkey, l_returnflag) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey""")
def page_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 7 % 90).cast("long").alias("confidence"), F.col("l_returnflag").alias("font"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    return statements.page_statistics(li.join(pages, "page", "left_semi")).withColumn("mean", F.round("mean", 6))


# --- predicates over texts and rows ---------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'pago ' || p_brand END AS concept, CASE WHEN p_partkey % 3 = 0 THEN 'Ana Sol' ELSE 'Luz Mar' END AS counterparty,
  CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS reference, CASE WHEN p_partkey % 5 = 0 THEN '1234' END AS card FROM part""")
def detail_fields(spark, sf_dir):
    k = F.col("p_partkey")
    number = F.lpad(k.cast("string"), 7, "0")
    said = F.when(k % 4 == 0, F.concat(F.lit("0506260pago "), F.col("p_brand"), F.lit(" Referencia "), number)).when(k % 2 == 0, F.concat(F.lit("BNET 0162238802 pago "), F.col("p_brand"), F.lit(" Referencia "), number)).otherwise("012 sin concepto 9")
    detail = F.concat_ws(" | ", said, F.lit("Luz Mar"), F.lit("RFC ABC DEF"), F.when(k % 5 == 0, "AUT: 9 ******1234"), F.when(k % 3 == 0, "Ana Sol"))
    return table(spark, sf_dir, "part").select("p_partkey", text.detail_fields(detail).alias("d")).select("p_partkey", "d.concept", "d.counterparty", "d.reference", "d.card")


@query("""SELECT o_orderkey, greatest(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT), 150) AS estimate_minor, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS number FROM orders""")
def estimates(spark, sf_dir):
    cents = F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long")
    raw = F.concat(F.lit("ref 9 1.50 y "), _amount(cents), F.lit(" mas 77"))
    number = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" "))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", money.estimate_minor(raw).alias("estimate_minor"), money.try_long(number).alias("number"))


_KINDS = ("csv", "xlsx", "pdf_template:nu", "pdf_ocr_template:gbm", "pdf_ebcdic_template:hsbc", "pdf_text", "xpdf_template:a")


@query(f"SELECT o_orderkey, {list(_KINDS)}[1 + CAST(o_orderkey % 8 AS INT)] AS method, coalesce(o_orderkey % 8 IN (2, 3, 4), false) AS native FROM orders")
def native_source(spark, sf_dir):
    method = F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", method.alias("method"), validate.native_source(method).alias("native"))


@query(r"""SELECT p_partkey, regexp_matches(' ' || lower(p_name) || ' ', '\bring\b') AS token, p_partkey % 4 = 0 AS short, p_partkey % 3 <> 2 AS holder FROM part""")
def mentions(spark, sf_dir):
    k = F.col("p_partkey")
    paid = F.concat(F.when(k % 4 == 0, "SPEI a Nu, ").otherwise("compra Nu, "), F.col("p_name"))
    named = F.when(k % 3 == 0, "abono de ANA MARÍA  Sol").when(k % 3 == 1, "ana maria-sol").otherwise("Ana Sol María")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.mentions_token(F.col("p_name"), F.lit("ring"), transfers.STOP_TOKENS).alias("token"), text.mentions_token(paid, F.lit("nu"), transfers.STOP_TOKENS, 3, transfers.TRANSFER_WORDS).alias("short"),
        text.mentions_holder(named, "Ana María Sol").alias("holder"),
    )


@query(f"WITH {TXN} SELECT transaction_id AS id, account_id FROM txn WHERE transaction_id % 200 = account_id")
def counterparty_tokens(spark, sf_dir):
    """Every movement names the brand of some account; which of them is its own."""
    rows = txn(spark, sf_dir)
    texts = rows.select(F.col("transaction_id").alias("id"), F.concat(F.lit("PAGO a Marca"), (F.col("transaction_id") % 200).cast("string"), F.lit(", gracias")).alias("text"), "account_id")
    tokens = rows.select("account_id").distinct().select("account_id", F.concat(F.lit("marca"), F.col("account_id").cast("string")).alias("token"))
    return transfers.token_mentions(texts, tokens)


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS approvable FROM orders")
def approve_guard(spark, sf_dir):
    k = F.col("o_orderkey")
    blocks = F.array_compact(F.array(F.when(k % 3 == 0, "currency_mismatch"), F.when(k % 5 == 0, "reconciliation_warning"), F.when(k % 7 == 0, "documento_excede_limite")))
    return table(spark, sf_dir, "orders").select("o_orderkey", validate.may_approve(blocks).alias("approvable"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'statement_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'file_sha256' END, CASE WHEN o_orderkey % 7 = 0 THEN 'original_name' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'currency' END, CASE WHEN o_orderkey % 13 = 0 THEN 'method' END, CASE WHEN o_orderkey % 17 = 0 THEN 'period' END, CASE WHEN o_orderkey % 19 = 0 THEN 'account_id' END], lambda x: x IS NOT NULL)), ',') AS errors FROM orders""")
def validate_statements(spark, sf_dir):
    k = F.col("o_orderkey")
    whole = F.sha2(k.cast("string"), 256)
    day = F.col("o_orderdate").cast("date")
    s = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "stmt_x").otherwise(F.concat(F.lit("stmt_"), F.substring(whole, 1, 16))).alias("statement_id"), F.when(k % 5 == 0, F.upper(whole)).otherwise(whole).alias("file_sha256"),
        F.when(k % 7 != 0, "a.pdf").alias("original_name"), F.when(k % 11 == 0, "mxn").otherwise("MXN").alias("currency"), F.when(k % 13 == 0, "fax").otherwise("pdf_ebcdic_template:hsbc").alias("method"),
        F.when(k % 17 == 0, F.date_add(day, 1)).otherwise(day).alias("period_start"), day.alias("period_end"), F.when(k % 19 != 0, "a").alias("account_id"))
    # an upper-case digest may have no letter to tell it by
    return s.withColumn("file_sha256", F.when(k % 5 == 0, F.lit("F" * 64)).otherwise(F.col("file_sha256"))).select("o_orderkey", F.concat_ws(",", validate.statement_errors()).alias("errors"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN s1 > s2 THEN 'a' WHEN s2 > s1 THEN 'b' END AS account_id, CAST(abs(s1 - s2) AS BIGINT) AS margin FROM (SELECT o_orderkey, o_orderkey % 9 AS s1, o_orderkey % 5 AS s2 FROM orders)
WHERE greatest(s1, s2) > 0 AND abs(s1 - s2) < 4""")
def fragile_accounts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit("a").alias("account_id"), (F.col("o_orderkey") % 9).alias("score")), F.struct(F.lit("b").alias("account_id"), (F.col("o_orderkey") % 5).alias("score")))).alias("s"))
    return identify.fragile(identify.identify_accounts(o.select("doc_id", "s.*")))


@query(f"""WITH {TXN}, c AS (SELECT statement_id, list(date_op || '|' || amount_minor || '|' || description ORDER BY date_op, amount_minor, description) AS body FROM txn GROUP BY 1)
SELECT DISTINCT CAST(statement_id AS VARCHAR) AS statement_id FROM c""")
def distinct_contents(spark, sf_dir):
    """Every statement twice, the second under a name that sorts behind."""
    rows = txn(spark, sf_dir).select(F.col("statement_id").cast("string").alias("statement_id"), "date_op", "amount_minor", F.concat("description", F.lit(" "), F.col("statement_id").cast("string")).alias("description_norm"))
    twice = rows.union(rows.withColumn("statement_id", F.concat("statement_id", F.lit("~copy"))))
    found = twice.select("statement_id", F.lit(dt.date(2024, 1, 1)).alias("period_start"), F.lit(dt.date(2024, 1, 31)).alias("period_end")).distinct()
    return duplicates.distinct_contents(found, twice).select("statement_id")


@query(f"""WITH {TXN} SELECT transaction_id FROM txn WHERE date_op BETWEEN DATE '2024-01-08' - 7 AND DATE '2024-01-12' + 7 AND transaction_id % 11 <> 0 AND transaction_id % 13 <> 0""")
def recent_pool(spark, sf_dir):
    k = F.col("transaction_id")
    committed = txn(spark, sf_dir).withColumn("dup_of", F.when(k % 11 == 0, "x")).withColumn("review_status", F.when(k % 13 == 0, "cuarentena").otherwise("ok"))
    new = spark.createDataFrame([(dt.date(2024, 1, 8), dt.date(2024, 1, 10)), (dt.date(2024, 1, 9), dt.date(2024, 1, 12))], "period_start date, period_end date")
    return transfers.recent_pool(committed, new).select("transaction_id")


@query(f"WITH {TXN} SELECT DISTINCT description FROM txn WHERE description NOT IN ('view', 'click')")
def unknown_kinds(spark, sf_dir):
    known = spark.createDataFrame([("view",), ("click",)], "description string")
    return txn(spark, sf_dir).select("description").exceptAll(known).distinct().join(known, "description", "left_anti")


@query(f"WITH {TXN} SELECT DISTINCT account_id AS end_id FROM txn WHERE amount_minor < 0 UNION SELECT transaction_id FROM txn WHERE amount_minor > 20000")
def union_endpoints(spark, sf_dir):
    rows = txn(spark, sf_dir)
    return rows.where("amount_minor < 0").select(F.col("account_id").alias("end_id")).union(rows.where("amount_minor > 20000").select("transaction_id")).distinct()


@query("""SELECT 'b' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name FROM orders ORDER BY o_orderkey DESC LIMIT 20""")
def retention(spark, sf_dir):
    """The newest twenty snapshots: a limit that is the feature."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("b"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("name")).orderBy(F.desc("name")).limit(20)


@query(f"""WITH {MOVES} SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY k * 997 % 20011) AS place, k FROM m""")
def consolidated_order(spark, sf_dir):
    """Locators of up to five digits, ordered as numbers."""
    rows = _moves(spark, sf_dir).select("statement_id", F.concat(F.lit("line:"), (F.col("k") * 997 % 20011).cast("string")).alias("locator"), "k")
    order = Window.partitionBy("statement_id").orderBy(*consolidated.locator_place(F.col("locator")))
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("statement_id", "place", "k")


@query(f"""WITH {TXN}, {DECLARED} SELECT statement_id, CASE WHEN closing_minor IS NULL OR account_id % 7 = 0 OR account_id % 5 = 0 THEN 'NO_CUADRA' ELSE 'OK' END AS state,
  CAST((closing_minor IS NULL OR account_id % 7 = 0)::INT + (account_id % 5 = 0)::INT AS BIGINT) AS n_problems, n_transactions AS n FROM declared
UNION ALL SELECT statement_id + 1000000, 'DUPLICADO', 0, n_transactions FROM declared WHERE statement_id % 3 = 0""")
def consolidated_check(spark, sf_dir):
    """Statements held against what they declare; every third was read twice."""
    base = txn(spark, sf_dir)
    rows = base.select("statement_id", F.concat(F.lit("line:"), F.col("transaction_id").cast("string")).alias("locator"), "date_op", "description", "amount_minor", F.lit(False).alias("doubtful"))
    start = F.make_date(F.lit(2024), F.lit(1), (F.col("statement_id") % 10 + 1).cast("int"))
    s = declared(base).select("*", start.alias("period_start"), start.alias("period_end"))
    again = lambda df: df.where("statement_id % 3 = 0").withColumn("statement_id", F.col("statement_id") + 1_000_000)
    checked = consolidated.check_statements(s.unionByName(again(s)), rows.unionByName(again(rows)))
    n = F.when(F.col("state") == "DUPLICADO", 0).otherwise(F.size("problems")).cast("long")
    return checked.select("statement_id", "state", n.alias("n_problems"), "n")
