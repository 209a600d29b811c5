import datetime as dt


from tallyspark.grammars import issuers, parse_lines
from tallyspark.operators.lines import text_lines, with_period

D = dt.date
DOCS = {
    "nu": ("nu", """Detalle de movimientos
10 ENE 2026 Tienda Azul | RFC: ABC +$1,250.50
04 FEB
Persona Uno +$7,726.18
2026
08 FEB Persona Dos Transferencia de
+$4,909.00
2026 Nomina
12 ABONOS
algo +$1.00
2026
11 ENE 2026 congelaste saldo -$5.00
Texto suelto largo
12 ENE 2026 13 ENE 2026 - $10.00
+ $109.00
14 ENE 2026 Cafe Luna""", None, None),
    "old": ("nu", """05 ENE Super Mercado $120.00
06 ENE Pago a tu tarjeta $300.00
07 ENE Devolución tienda $20.00
08 DIC. Compra a plazos 9.00
09 ENE Tienda $90.00 12.5% 3/12 $7.50
09 ENE Tienda $90.00 0% 1/3 $7.50
10 SEPT Aumentaste tu límite $5,000.00
11 ENE Reverso parcial - $70.00
Pagos a tu tarjeta en el periodo $300.00""", None, None),
    "gbm": ("gbm", """01/01/2026 Deposito 500.00 1,500.00
Rendimiento del 01/06/2026 9.00 8.00
02/01/2026 Compra 200.00 1,300.00
03/01/2026 Raro 10.00 1,250.00
04/01/2026 Sin saldo 10.00""", 100000, None),
    "hsbc": ("hsbc", """ 20 SPEI RECIBIDO ref 123456 $ 1 200.00 $ 3 200.00
05 24011346 COMPRA $200.00 $ 3 000.00
18 algo sin par $ 5.00""", 200000, None),
    "vexi": ("vexi", """05/01/2026 Cafe $50.00
06 ene 2026 Su pago recibido $500.00
07/01/2026 Comisión por pago tardío $300.00
Pago mínimo 08/01/2026 $20.00
09/01/2026 Ajuste -$1.00""", None, None),
    "bbva": ("bbva", """19/DIC 19/DIC SPEI ENVIADO LUNA 100.00
CLABE 123
concepto x
BBVA MEXICO, S.A. pie de pagina
20/DIC 21/DIC DEPOSITO SOL 400.00 1,300.00 1,300.00
05/ENE 05/ENE PAGO CUENTA DE TERCERO 70.00
05/ENE 05/ENE OTRO 30.00 1,340.00 1,340.00
TOTAL DE MOVIMIENTOS
no es detalle
06/ENE 06/ENE FINAL 40.00""", 100000, 130000),
    "card": ("bbva", """DESGLOSE DE MOVIMIENTOS
03-ene-2026 04-ene-2026 TIENDA WEB ; Tarjeta Digital ***1234 + $1,771.00
USD $100.00 TIPO DE CAMBIO $17.71
05-ene-2026 05-ene-2026 SU PAGO - $500.00""", None, None),
}

DOCS["none"] = (None, """Saldo inicial: $1,000.00
05/01/2026 Tienda $20.00
2026-01-06 Otra 1,5
07 ene 2026  Nomina  (1,000.00)
08/01/2026 sin importe legible""", None, None)


def parsed(spark):
    rows = [(k, bank, text, D(2025, 12, 19), D(2026, 1, 18), opening, closing) for k, (bank, text, opening, closing) in DOCS.items()]
    docs = spark.createDataFrame(rows, "doc_id string, bank string, text string, period_start date, period_end date, opening_minor long, closing_minor long")
    got = {}
    for r in parse_lines(text_lines(docs), docs).orderBy("doc_id", "line_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    return docs, got


def test_grammars(spark):
    docs, got = parsed(spark)
    short = {k: [(str(r["date_op"]) if r["date_op"] else None, r["description"], r["amount_minor"], r["doubtful"]) for r in v] for k, v in got.items()}
    assert short["nu"] == [
        ("2026-01-10", "Tienda Azul", 125050, False), ("2026-02-04", "Persona Uno", 772618, False), ("2026-02-08", "Persona Dos Transferencia de Nomina", 490900, False),
        ("2026-01-12", "Texto suelto largo", -1000, False), ("2026-01-14", "Cafe Luna", 10900, False),
    ]
    assert short["old"] == [("2026-01-05", "Super Mercado", 12000, False), ("2026-01-06", "Pago a tu tarjeta", -30000, False), ("2026-01-07", "Devolución tienda", 2000, True), ("2025-12-08", "Compra a plazos", 900, False), ("2026-01-11", "Reverso parcial", -7000, False)]
    assert short["gbm"] == [("2026-01-01", "Deposito", 50000, False), ("2026-01-02", "Compra", -20000, False), ("2026-01-03", "Raro", -1000, True)]
    assert short["hsbc"] == [("2025-12-20", "SPEI RECIBIDO ref 123456", 120000, False), ("2026-01-05", "24011346 COMPRA", -20000, False)]
    assert short["vexi"] == [("2026-01-05", "Cafe", 5000, False), ("2026-01-06", "Su pago recibido", -50000, False), ("2026-01-07", "Comisión por pago tardío", 30000, False), ("2026-01-09", "Ajuste", -100, False)]
    assert short["bbva"] == [("2025-12-19", "SPEI ENVIADO LUNA", -10000, False), ("2025-12-20", "DEPOSITO SOL", 40000, False), ("2026-01-05", "PAGO CUENTA DE TERCERO", 7000, False), ("2026-01-05", "OTRO", -3000, False), ("2026-01-06", "FINAL", -4000, False)]
    assert got["bbva"][0]["detail"] == "CLABE 123 | concepto x" and str(got["bbva"][1]["date_post"]) == "2025-12-21" and got["bbva"][1]["balance_minor"] == 130000
    assert short["card"] == [("2026-01-03", "TIENDA WEB", 177100, False), ("2026-01-05", "SU PAGO", -50000, False)]
    assert short["none"] == [("2026-01-05", "Tienda", 2000, False), ("2026-01-06", "Otra", 150, False), ("2026-01-07", "Nomina", -100000, False)]
    assert got["card"][0]["detail"] == "Tarjeta Digital ***1234 | USD $100.00 TIPO DE CAMBIO $17.71"


def test_summaries(spark):
    rows = [("a", "nu", "Saldo inicial del periodo (ENE 2026): - $188.50\nSaldo total del periodo $20.00\nDinero generado este mes $1.23", D(2026, 1, 31)), ("b", "uala", "Adeudo del periodo anterior $5.00 Pago para no generar intereses2 $1,234.56", None), ("c", "bbva", "Depósitos / Abonos (+) 3 14,163.00 Retiros / Cargos (-) 2 100.00", None), ("d", "hsbc", "nada", None)]
    docs = spark.createDataFrame(rows, "doc_id string, bank string, text string, period_end date")
    got = {r["doc_id"]: (r["summary_opening"], r["summary_closing"], r["declared_credits"], r["declared_debits"], r["declared_count"]) for r in issuers.summaries(docs).collect()}
    assert got == {"a": (-18850, 2000, None, None, None), "b": (500, 123456, None, None, None), "c": (None, None, 1416300, -10000, 5), "d": (None,) * 5}
    none = spark.createDataFrame([], "doc_id string, description string")
    extra = issuers.summary_rows(docs, none).collect()
    assert [(r["doc_id"], r["amount_minor"], str(r["date_op"])) for r in extra] == [("a", 123, "2026-01-31")]
    listed = spark.createDataFrame([("a", "Dinero generado")], "doc_id string, description string")
    assert issuers.summary_rows(docs, listed).count() == 0




def test_nothing_is_left_out_in_silence(spark):
    docs, _ = parsed(spark)
    got = {}
    for r in issuers.warnings(text_lines(docs), docs).orderBy("doc_id", "line_no").collect():
        got.setdefault(r["doc_id"], []).append((r["line_no"], r["warning"]))
    assert got["nu"] == [(12, "excluded by its label"), (16, "amount taken from the line before")]
    assert got["old"] == [(k, "excluded by its label") for k in (5, 6, 7)]
    assert got["gbm"] == [(5, "dated line without amount and balance")] and got["hsbc"] == [(3, "dated line without amount and balance")]
    assert got["none"] == [(5, "dated line not understood")] and not {"vexi", "bbva", "card"} & set(got)


def test_older_card_of_no_issuer_and_wrong_totals(spark):
    rows = [("x", None, "05 ENE Super $120.00\n06 ENE Pago a tu tarjeta $30.00\nPagos a tu tarjeta en el periodo $30.01"), ("y", "nu", "05 ENE Super $120.00\n06 ENE Pago a tu tarjeta $30.00\nPagos a tu tarjeta en el periodo $30.01")]
    docs = spark.createDataFrame([(*r, D(2025, 12, 19), D(2026, 1, 18), None, None) for r in rows], "doc_id string, bank string, text string, period_start date, period_end date, opening_minor long, closing_minor long")
    got = parse_lines(text_lines(docs), docs).collect()
    assert {(r["doc_id"], r["amount_minor"], r["doubtful"]) for r in got if r["doc_id"] == "y"} == {("y", 12000, True), ("y", -3000, True)}
    assert {(r["doc_id"], r["line_no"], r["warning"]) for r in issuers.warnings(text_lines(docs), docs).collect() if r["doc_id"] == "y"} == {("y", None, "payments differ from the declared total")}


def test_periods(spark):
    said = {
        "Periodo: 29 MAY 2026 al 27 JUN 2026": ("2026-05-29", "2026-06-27"), "ESTADO DE CUENTA del 30/12/2025 - 03/01/2026": ("2025-12-30", "2026-01-03"), "Período del 01/06/2026 — 30/06/2026": ("2026-06-01", "2026-06-30"),
        "promo del 1 ene 2026 al 5 ene 2026": None, "Periodo: del 01 al 31 ene 2026": ("2026-01-01", "2026-01-31"), "Fecha de corte: 28 feb 2026\nx\nNúm. de días del periodo: 29": ("2026-01-31", "2026-02-28"),
        "Fecha de corte 28 feb 2026 Número de días en el periodo 99": None, "Periodo: Enero 2026 y Días del periodo 31": ("2026-01-01", "2026-01-31"), "Periodo: Enero 2026 y Días del periodo 30": None,
        "Periodo: 31/02/2026 al 05/03/2026 Fecha de corte: 28 feb 2026 Núm de días del periodo 30": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in said], "t string")
    got = {r["t"]: (str(r["period_start"]), str(r["period_end"])) if r["period_start"] else None for r in with_period(rows, "t").collect()}
    assert got == said
