"""The same questions in SQL over the given tables, asked another way where there is one:
as-of joins instead of a calendar join, joins per payment instead of running totals."""

from arqueo import constants as C
from checks.queries import CHOSEN_RISKS, CHOSEN_SUPPLIERS, CYCLE_STEPS, LAYERED, LOAN_TERMS, ONE_INVOICE, SHARED_NUMBERS, SPREADS, YOUNG_CURVE
from checks.tables import BILLS_AS_OF, FX_AS_OF, STATEMENT_LABELS

FX_DAY, BILL_DAY = f"DATE '{FX_AS_OF}'", f"DATE '{BILLS_AS_OF}'"
MONTH_START, LAST_MONTH_END = f"DATE '{FX_AS_OF.replace(day=1)}'", "DATE '2001-06-30'"


def m(value: str, places: int = 2) -> str:
    return f"CAST(CAST({value} AS DECIMAL(24,{places})) AS DOUBLE)"


def d(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d')"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(names: str, select: str) -> str:
    """Prefix the named common tables, with what they need, in order."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(f"{name} AS ({TABLES[name]})" for name in wanted) + "\n" + select


NEEDS = {
    "rango": ("facturas", "pagos_usd"), "trm": ("publicadas", "rango"), "ultimas": ("trm",), "con_tasa": ("facturas", "trm"),
    "cruce": ("facturas", "pagos_usd"), "resumen": ("con_tasa", "ultimas", "cruce"), "tramos": ("con_tasa", "pagos_usd"),
    "filas_densas": ("tramos", "trm"), "filas_densas_n": ("tramos_n", "trm"),
    "denso": ("tramos", "trm"), "tramos_n": ("con_tasa_n", "pagos_usd"), "denso_n": ("tramos_n", "trm"), "edad": ("compras",), "pagadas": ("compras",), "abiertas": ("compras", "pagadas"),
    "cierres": ("reales",), "libro": ("cierres",), "numeros": ("filas",), "partidas": ("numeros",),
    "numeros_m": ("filas_m",), "partidas_m": ("numeros_m",), "numeros_e": ("filas_e",), "partidas_e": ("numeros_e",), "deuda": ("compras",), "dias_e": ("partidas_e", "deuda"),
    "semanas": ("abiertas",), "cuotas": ("prestamos",), "cobro": ("resumen", "ultimas"),
    "compartidas": ("con_tasa",), "abonos_c": ("pagos_usd",), "cambios_c": ("compartidas", "abonos_c"), "con_tasa_n": ("con_tasa", "ultimas"), "movs": ("con_tasa_n", "pagos_usd", "trm"),
}

WORD = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def last_number(cell: str) -> str:
    """Rightmost word with a digit that parses; the list keeps only words that parsed."""
    def later(w: str) -> str:
        return f"length({w}) - strpos(reverse({w}), ',') > length({w}) - strpos(reverse({w}), '.')"

    commas, dots = "(length(w) - length(replace(w, ',', '')))", "(length(w) - length(replace(w, '.', '')))"
    plain = f"""CASE WHEN {commas} > 0 AND {dots} > 0 THEN
        CASE WHEN {later('w')} THEN replace(replace(w, '.', ''), ',', '.') ELSE replace(w, ',', '') END
      WHEN {commas} = 1 AND length(split_part(w, ',', 2)) <= 2 THEN replace(w, ',', '.')
      WHEN {commas} >= 1 THEN replace(w, ',', '')
      WHEN {dots} > 1 OR ({dots} = 1 AND length(split_part(w, '.', 2)) = 3) THEN replace(w, '.', '')
      ELSE w END"""
    sign = "CASE WHEN strpos(w, '-') > 0 OR (strpos(w, '(') > 0 AND strpos(w, ')') > 0) THEN -1 ELSE 1 END"
    words = f"list_filter(list_reverse(regexp_split_to_array(replace({cell}, '$', ' '), '{WORD}')), lambda w: regexp_matches(w, '[0-9]'))"
    parsed = f"list_transform({words}, lambda w: ({sign}) * TRY_CAST(regexp_replace({plain}, '[^0-9.]', '', 'g') AS DOUBLE))"
    return f"list_filter({parsed}, lambda v: v IS NOT NULL)[1]"


def risk(due: str) -> str:
    late = f"date_diff('day', {due}, {BILL_DAY})"
    return (f"CASE WHEN {late} > 30 THEN {text(C.RISK_CRITICAL)} WHEN {late} >= 1 THEN {text(C.RISK_RECENT)} "
            f"WHEN {late} BETWEEN -7 AND -1 THEN {text(C.RISK_SOON)} ELSE {text(C.RISK_CURRENT)} END")


def installment(amount: str, rate: str, months: str) -> str:
    monthly = f"(pow(1 + {rate}, 1.0/12.0) - 1)"
    growth = f"pow(1 + {monthly}, {months})"
    return (f"CASE WHEN {amount} <= 0 OR {months} <= 0 THEN 0.0 WHEN {rate} = 0 THEN CAST({amount} AS DOUBLE) / {months} "
            f"ELSE CAST({amount} AS DOUBLE) * ({monthly} * {growth}) / ({growth} - 1) END")


def statement_rows(entity: str) -> str:
    labels = "[" + ", ".join(map(text, STATEMENT_LABELS)) + "]"
    size = len(STATEMENT_LABELS)
    english = "format('{:,.2f}', o_totalprice)"
    return f"""SELECT CAST({entity} AS VARCHAR) AS entity_id, CAST(year(o_orderdate) AS VARCHAR) AS f, month(o_orderdate) AS s, o_orderkey AS r,
      {labels}[CAST(o_orderkey % {size} AS INTEGER) + 1] AS etiqueta, 'Nota ' || (o_orderkey % 9) AS nota,
      CASE (o_orderkey // {size}) % 6 WHEN 0 THEN '$ ' || {english} WHEN 1 THEN translate({english}, ',.', '.,')
        WHEN 2 THEN '(' || {english} || ')' WHEN 3 THEN '0' WHEN 4 THEN 'N/A'
        ELSE replace(format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') END AS importe FROM orders"""


def statement_numbers(rows: str) -> str:
    return f"""SELECT entity_id, f, s, r, upper(etiqueta || ' ' || nota || ' ' || importe) AS linea,
      abs(coalesce({last_number('importe')}, {last_number('nota')}, {last_number('etiqueta')})) AS n FROM {rows}"""


def items(rows: str) -> str:
    columns = []
    for name, words in C.STATEMENT_KEYWORDS.items():
        hit = " OR ".join(f"contains(linea, {text(word)})" for word in words)
        columns.append(f'coalesce(arg_min(n, (f, s, r)) FILTER (WHERE n <> 0 AND ({hit})), 0.0) AS "{name}"')
    return f"SELECT entity_id, {', '.join(columns)} FROM {rows} GROUP BY entity_id"


def guard(name: str) -> str:
    return f'(CASE WHEN "{name}" > 0 THEN "{name}" ELSE 1 END)'


RATIOS = {
    "Razón Corriente": f'"Activo Corriente" / {guard("Pasivo Corriente")}',
    "Prueba Ácida": f'("Activo Corriente" - "Inventarios") / {guard("Pasivo Corriente")}',
    "Capital de Trabajo": '"Activo Corriente" - "Pasivo Corriente"',
    "Nivel Endeudamiento": f'"Pasivo Total" / {guard("Activo Total")}',
    "Cobertura Intereses": f'"Utilidad Operativa" / {guard("Gastos Financieros")}',
    "Margen Bruto": f'"Utilidad Bruta" / {guard("Ingresos")}',
    "Margen Operativo": f'"Utilidad Operativa" / {guard("Ingresos")}',
    "Margen Neto": f'"Utilidad Neta" / {guard("Ingresos")}',
    "ROA": f'"Utilidad Neta" / {guard("Activo Total")}',
    "ROE": f'"Utilidad Neta" / {guard("Patrimonio")}',
}
RATIO_LIST = ", ".join(f'round({value}, 6) AS "{name}"' for name, value in RATIOS.items())


def by(column: str, *values: str) -> str:
    return ", ".join(
        f"coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE {column} = '{v}'), 0)::DECIMAL(18,2) AS {name}"
        for name, v in (pair.split("=") for pair in values))


def spans(invoices: str) -> str:
    """One span per invoice and distinct payment day from its date on: every span start meets every payment."""
    fields = "i.entity_id, i.factura, i.cliente, i.ff, i.v, i.t, i.a"
    none = "CASE WHEN t IS NOT NULL THEN 0 END"
    return f"""SELECT i.entity_id, i.factura, i.cliente, i.ff, i.v, i.t, i.a AS desde,
        lead(i.a) OVER (PARTITION BY i.entity_id, i.factura ORDER BY i.a) - 1 AS hasta,
        coalesce(sum(usd) FILTER (WHERE p.fecha < ff), 0)::DECIMAL(18,2) AS antes,
        coalesce(sum(usd) FILTER (WHERE p.fecha >= ff AND p.fecha <= i.a), 0)::DECIMAL(18,2) AS abonos,
        coalesce(sum((t - tasa) * usd) FILTER (WHERE p.fecha < ff), {none})::DECIMAL(38,6) AS anticipos,
        coalesce(sum((tasa - t) * usd) FILTER (WHERE p.fecha >= ff AND p.fecha <= i.a), {none})::DECIMAL(38,6) AS realizada
        FROM (SELECT *, ff AS a FROM {invoices} WHERE ff IS NOT NULL
              UNION SELECT c.*, p.fecha FROM {invoices} c JOIN pagos_usd p USING (entity_id, factura) WHERE p.fecha >= c.ff) i
        LEFT JOIN pagos_usd p USING (entity_id, factura) GROUP BY {fields}"""


def dense(source: str) -> str:
    """One row per invoice and rate day from its date on."""
    first, last = "(SELECT min(fecha) FROM trm)", "(SELECT max(fecha) FROM trm)"
    days = f"range(greatest(desde, {first}), least(coalesce(hasta, DATE '9999-01-01'), {last}) + 1, INTERVAL 1 DAY)"
    return f"""SELECT s.entity_id, s.factura, d.fecha, d.trm, s.abonos, greatest(v - antes - abonos, 0) AS saldo, anticipos, realizada,
        CAST(greatest(v - antes - abonos, 0) * (d.trm - t) AS DECIMAL(38,6)) AS no_realizada
        FROM (SELECT *, CAST(unnest({days}) AS DATE) AS dia FROM {source}) s JOIN trm d ON d.fecha = s.dia"""


def dense_rows(source: str) -> str:
    """Every column of every row of the dense detail: the days from the invoice date on, and zeros on the days before."""
    first, last = "(SELECT min(fecha) FROM trm)", "(SELECT max(fecha) FROM trm)"
    days = f"range(greatest(desde, {first}), least(coalesce(hasta, DATE '9999-01-01'), {last}) + 1, INTERVAL 1 DAY)"
    return f"""SELECT s.entity_id, d.fecha, s.factura, s.cliente, s.v, s.t, s.antes, s.abonos, greatest(v - antes - abonos, 0)::DECIMAL(18,2) AS saldo,
        anticipos, realizada, CAST(greatest(v - antes - abonos, 0) * (d.trm - t) AS DECIMAL(38,6)) AS no_realizada, d.trm
        FROM (SELECT *, CAST(unnest({days}) AS DATE) AS dia FROM {source}) s JOIN trm d ON d.fecha = s.dia
        UNION ALL SELECT s.entity_id, d.fecha, s.factura, s.cliente, s.v, s.t, s.antes, 0, 0, 0, 0, 0, d.trm
        FROM {source} s JOIN trm d ON d.fecha < s.ff WHERE s.desde = s.ff"""


def fingerprint(rows: str, *more: str) -> str:
    """Per company and month the number of rows and the sum of a hash of all columns of each."""
    scaled = {"v": 2, "t": 4, "antes": 2, "abonos": 2, "saldo": 2, "anticipos": 6, "realizada": 6, "no_realizada": 6,
              "anticipos + realizada + no_realizada": 6, "trm": 4} | dict.fromkeys(more, 6)
    values = [f"CAST(CAST({value} AS DECIMAL(28,{places})) * {10 ** places} AS HUGEINT)::VARCHAR" for value, places in scaled.items()]
    texts = ", ".join(f"coalesce({value}, 'null')" for value in ("strftime(fecha, '%Y-%m-%d')", "factura", "cliente", *values))
    return f"""SELECT entity_id, strftime(fecha, '%Y-%m') AS mes, count(*) AS filas,
        sum(('0x' || substr(md5(concat_ws('|', {texts})), 1, 12))::BIGINT)::VARCHAR AS huella FROM {rows} GROUP BY 1, 2"""


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BALANCE = "greatest(v - antes - desde, 0)"
PLAIN_BILL = "entity_id, PROVEEDOR, FACTURA"

TABLES = {
    "facturas": """SELECT CAST(o_orderkey % 5 AS VARCHAR) AS entity_id, CAST(o_orderkey AS VARCHAR) AS factura,
        CAST(o_custkey AS VARCHAR) AS cliente, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS ff,
        CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE o_orderkey % 37 <> 0 AND o_totalprice > 0""",
    "pagos_usd": """SELECT CAST(l_orderkey % 5 AS VARCHAR) AS entity_id, CAST(l_orderkey AS VARCHAR) AS factura,
        CASE WHEN l_partkey % 101 <> 0 THEN CAST(l_shipdate AS DATE) END AS fecha, CAST(l_extendedprice AS DECIMAL(18,2)) AS usd,
        CASE WHEN l_partkey % 97 <> 0 THEN CAST(3000 + 1000 * CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,4)) END AS tasa FROM lineitem""",
    "publicadas": """SELECT dia, tasa, coalesce(lead(dia) OVER (ORDER BY dia) - 1, dia + 6) AS fin FROM (
        SELECT CAST(o_orderdate AS DATE) + CASE dayofweek(o_orderdate) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS dia,
          CAST(3000 + sum(CAST(o_totalprice AS DECIMAL(18,2))) % 911 AS DECIMAL(18,4)) AS tasa FROM orders GROUP BY 1)""",
    "rango": "SELECT least((SELECT min(ff) FROM facturas), (SELECT min(fecha) FROM pagos_usd)) AS primero",
    "trm": f"""SELECT CAST(g.dia AS DATE) AS fecha, p.tasa AS trm FROM rango,
        LATERAL (SELECT unnest(generate_series(primero, {FX_DAY}, INTERVAL 1 DAY)) AS dia) g
        JOIN publicadas p ON CAST(g.dia AS DATE) BETWEEN p.dia AND p.fin""",
    "ultimas": f"""SELECT (SELECT trm FROM trm ORDER BY fecha DESC LIMIT 1) AS actual,
        (SELECT trm FROM trm ORDER BY fecha DESC LIMIT 1 OFFSET 1) AS ayer,
        (SELECT trm FROM trm WHERE fecha <= {LAST_MONTH_END} ORDER BY fecha DESC LIMIT 1) AS cierre""",
    "con_tasa": "SELECT f.*, t.trm AS t FROM facturas f ASOF LEFT JOIN trm t ON f.ff >= t.fecha",
    "con_tasa_n": "SELECT c.entity_id, factura, cliente, ff, v, coalesce(t, actual) AS t FROM con_tasa c, ultimas WHERE ff IS NOT NULL",
    "cruce": """SELECT f.entity_id, f.factura,
        coalesce(sum(usd) FILTER (WHERE ff IS NULL OR fecha < ff), 0)::DECIMAL(18,2) AS antes,
        coalesce(sum(usd) FILTER (WHERE fecha >= ff), 0)::DECIMAL(18,2) AS desde,
        coalesce(sum(usd) FILTER (WHERE fecha < ff AND tasa IS NOT NULL), 0)::DECIMAL(18,2) AS antes_t,
        coalesce(sum(usd) FILTER (WHERE fecha >= ff AND tasa IS NOT NULL), 0)::DECIMAL(18,2) AS desde_t,
        coalesce(sum(usd * tasa) FILTER (WHERE fecha < ff), 0)::DECIMAL(38,6) AS antes_c,
        coalesce(sum(usd * tasa) FILTER (WHERE fecha >= ff), 0)::DECIMAL(38,6) AS desde_c
        FROM facturas f LEFT JOIN pagos_usd p USING (entity_id, factura) GROUP BY ALL""",
    "resumen": f"""SELECT c.entity_id, c.factura, cliente, ff, v, CASE WHEN ff IS NOT NULL THEN coalesce(t, actual) END AS tf,
        antes, desde, {BALANCE} AS saldo,
        CASE WHEN ff IS NULL THEN 0 ELSE coalesce(t, actual) * antes_t - antes_c END AS anticipos,
        CASE WHEN ff IS NULL THEN 0 ELSE desde_c - coalesce(t, actual) * desde_t END AS realizada,
        CASE WHEN ff IS NULL THEN 0 ELSE {BALANCE} * (actual - coalesce(t, actual)) END AS no_realizada,
        CASE WHEN ff IS NULL THEN 0 WHEN ff >= {MONTH_START} THEN {BALANCE} * (actual - coalesce(t, actual))
          ELSE {BALANCE} * (actual - cierre) END AS mes,
        CASE WHEN ff IS NULL THEN 0 ELSE {BALANCE} * (actual - ayer) END AS base,
        CASE WHEN ff IS NULL THEN 0 ELSE {BALANCE} * CAST(actual * 1.02 - ayer AS DECIMAL(18,6)) END AS mas,
        CASE WHEN ff IS NULL THEN 0 ELSE {BALANCE} * CAST(actual * 0.98 - ayer AS DECIMAL(18,6)) END AS menos
        FROM con_tasa c JOIN cruce USING (entity_id, factura), ultimas""",
    "tramos": spans("con_tasa"), "tramos_n": spans("con_tasa_n"), "denso": dense("tramos"), "denso_n": dense("tramos_n"),
    "filas_densas": dense_rows("tramos"), "filas_densas_n": dense_rows("tramos_n"),
    "compras": """SELECT CAST(s_nationkey % 5 AS VARCHAR) AS entity_id, s_name AS PROVEEDOR, CAST(l_orderkey AS VARCHAR) AS FACTURA,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS VALOR, CAST(o_orderdate AS DATE) AS GENERACIO,
        CAST(o_orderdate AS DATE) + 15 * l_linenumber AS VENCIMIENTO, l_returnflag AS devuelta, s_nationkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "edad": f"""SELECT *, strftime(GENERACIO, '%Y-%m') AS MES_GENERACION, date_diff('day', GENERACIO, VENCIMIENTO) AS DIAS_CREDITO,
        VENCIMIENTO < {BILL_DAY} AS VENCIDA, greatest(date_diff('day', VENCIMIENTO, {BILL_DAY}), 0) AS DIAS_VENCIDA,
        date_diff('day', {BILL_DAY}, VENCIMIENTO) AS DIAS_PARA_VENCER,
        date_diff('day', {BILL_DAY}, VENCIMIENTO) BETWEEN 1 AND 7 AS PROXIMO_A_VENCER, {risk('VENCIMIENTO')} AS RIESGO FROM compras""",
    "pagadas": "SELECT * FROM compras WHERE devuelta = 'R'",
    "abiertas": """SELECT * FROM compras c WHERE NOT EXISTS (
        SELECT 1 FROM pagadas p WHERE p.entity_id = c.entity_id AND p.FACTURA IS NOT DISTINCT FROM c.FACTURA)""",
    "semanas": f"""SELECT entity_id, w.week, coalesce(sum(VALOR) FILTER (WHERE
          VENCIMIENTO <= lunes + 7 * w.week - 1 AND (w.week = 1 OR VENCIMIENTO >= lunes + 7 * (w.week - 1))), 0) AS proveedores
        FROM abiertas, (SELECT CAST(date_trunc('week', {BILL_DAY}) AS DATE) AS lunes), (SELECT unnest([1, 2, 3, 4]) AS week) w GROUP BY ALL""",
    "deuda": f"""SELECT entity_id, sum(VALOR) AS total, coalesce(sum(VALOR) FILTER (WHERE VENCIMIENTO < {BILL_DAY}), 0) AS vencido
        FROM compras GROUP BY entity_id""",
    "plan": f"""SELECT CAST(o_orderkey % 5 AS VARCHAR) AS entity_id, CAST((o_orderkey // 5) % 4 + 1 AS INTEGER) AS week,
        {by("o_orderstatus", "saldo_inicial=P", "n_sue=F", "n_ss=O")},
        {by("o_orderpriority", *(f"{n}={p}" for n, p in zip(("ordinarios", "extra", "f_serv", "f_arr", "f_otr"), PRIORITIES)))}
        FROM orders GROUP BY 1, 2""",
    "prestamos": """SELECT CAST(c_nationkey % 5 AS VARCHAR) AS entity_id,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'leaseback' ELSE 'credito' END AS tipo, CAST(c_acctbal AS DECIMAL(18,2)) AS monto,
        (c_custkey % 10) * 0.03::DOUBLE AS tasa, (c_custkey % 7) * 6 AS meses, c_custkey % 3 <> 0 AS activo FROM customer""",
    "cuotas": f"SELECT *, {installment('monto', 'tasa', 'meses')} AS cuota FROM prestamos",
    "cobro": """SELECT entity_id, CAST(sum(saldo) FILTER (WHERE ff IS NOT NULL) * CAST(any_value(actual) * 0.20 AS DECIMAL(18,6)) AS DECIMAL(38,6)) AS cartera
        FROM resumen, ultimas GROUP BY entity_id""",
    "reales": f"""SELECT CAST(o_orderkey % 5 AS VARCHAR) AS entity_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS w,
        {by("o_orderstatus", "a=F", "b=O", "c=P")}, {by("o_orderpriority", *(f"{n}={p}" for n, p in zip("defg", PRIORITIES)))}
        FROM orders GROUP BY 1, 2""",
    "cierres": """SELECT entity_id, w, strftime(w, '%d/%m') || ' - ' || strftime(w + 6, '%d/%m') AS semana, a + b + c AS entra,
        d + e + f + g AS sale, a + b + c - d - e - f - g AS neto FROM reales""",
    "libro": "SELECT * FROM cierres WHERE w < CASE WHEN CAST(entity_id AS INTEGER) % 2 = 0 THEN DATE '1999-06-28' ELSE DATE '1999-06-14' END",
    "archivos": """SELECT l_orderkey AS k, l_suppkey AS p, l_linenumber AS n, l_quantity AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CAST(o_orderdate AS DATE) AS g,
        CAST(o_orderdate AS DATE) + 15 * l_linenumber AS ve, CASE WHEN l_orderkey % 4 = 1 AND l_orderkey % 23 = 0 THEN 'sin PROVEEDOR' WHEN l_orderkey % 29 = 0 THEN 'VALOR ilegible' END AS motivo
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "hoja": """SELECT *, CASE WHEN k % 31 = 0 THEN 'sin GENERACIO' WHEN k % 23 = 0 THEN 'sin PROVEEDOR' WHEN k % 37 = 0 THEN 'GENERACIO ilegible'
        WHEN k % 41 = 0 THEN 'VENCIMIENTO ilegible' WHEN k % 29 = 0 THEN 'VALOR ilegible' END AS motivo
        FROM (SELECT l_orderkey AS k, l_suppkey AS p, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CAST(o_orderdate AS DATE) AS g, CAST(o_orderdate AS DATE) + 15 * l_linenumber AS ve
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "filas_m": f"SELECT * REPLACE (CAST(f AS INTEGER) * 7 % 11 AS f) FROM ({statement_rows('o_orderkey % 5')}) WHERE CAST(f AS INTEGER) * 7 % 11 <> 3",
    "numeros_m": statement_numbers("filas_m"), "partidas_m": items("numeros_m"),
    "filas": statement_rows("o_custkey"), "filas_e": statement_rows("o_orderkey % 5"),
    "numeros": statement_numbers("filas"), "numeros_e": statement_numbers("filas_e"),
    "partidas": items("numeros"), "partidas_e": items("numeros_e"),
    "dias_e": """SELECT entity_id, "Cuentas por Cobrar" / nullif("Ingresos", 0) * 360 AS dso, "Inventarios" / nullif("Costo de Venta", 0) * 360 AS dio,
        coalesce(CAST(total AS DOUBLE), 0) / nullif("Costo de Venta", 0) * 360 AS dpo, "Ingresos" AS ventas
        FROM partidas_e LEFT JOIN deuda USING (entity_id)""",
    "compartidas": f"""SELECT entity_id, CAST(CAST(factura AS BIGINT) % {SHARED_NUMBERS} AS VARCHAR) AS factura, ff, v, t, row_number() OVER () AS id FROM con_tasa WHERE ff IS NOT NULL""",
    "abonos_c": f"""SELECT *, sum(usd) OVER (PARTITION BY entity_id, factura ORDER BY fecha) AS hasta FROM (
        SELECT entity_id, n AS factura, fecha, sum(u) AS usd, coalesce(sum(u) FILTER (WHERE tasa IS NOT NULL), 0) AS usd_t, coalesce(sum(u * tasa), 0) AS cop FROM (
          SELECT *, CAST(CAST(factura AS BIGINT) % {SHARED_NUMBERS} AS VARCHAR) AS n,
            CASE WHEN CAST(factura AS BIGINT) % {SHARED_NUMBERS} < 20 AND CAST(floor(usd) AS BIGINT) % 5 = 0 THEN -usd ELSE usd END AS u FROM pagos_usd WHERE fecha <= {FX_DAY}) GROUP BY ALL)""",
    # A row per invoice and payment day.
    "cambios_c": """SELECT entity_id, dia, sum(s) AS s, sum(s) FILTER (WHERE t IS NOT NULL) AS s_t, sum(s * t) AS st, sum(ant) AS ant, sum(rea) AS rea FROM (
        SELECT i.entity_id, ff AS dia, t, greatest(v - coalesce(sum(usd), 0), 0) AS s, t * coalesce(sum(usd_t), 0) - coalesce(sum(cop), 0) AS ant, 0 AS rea
        FROM compartidas i LEFT JOIN abonos_c p ON p.entity_id = i.entity_id AND p.factura = i.factura AND p.fecha < ff GROUP BY i.entity_id, id, ff, t, v
        UNION ALL SELECT i.entity_id, p.fecha, t, greatest(v - hasta, 0) - greatest(v - hasta + usd, 0), 0, cop - t * usd_t
        FROM compartidas i JOIN abonos_c p ON p.entity_id = i.entity_id AND p.factura = i.factura AND p.fecha >= ff) GROUP BY ALL""",
    "movs": """SELECT p.entity_id, p.factura, p.fecha, p.usd, p.tasa, c.ff, c.t, r.trm, CASE WHEN p.fecha < c.ff THEN 'Anticipo' ELSE 'Post-factura' END AS tipo
        FROM pagos_usd p JOIN con_tasa_n c USING (entity_id, factura) ASOF LEFT JOIN trm r ON p.fecha >= r.fecha WHERE p.fecha IS NOT NULL""",
}

SUMMARY = f"""entity_id, factura, cliente, {d('ff')} AS fecha_factura, {m('v')} AS valor_usd, {m('tf', 4)} AS trm_factura,
  {m('antes')} AS anticipo_previo_total_usd, {m('desde')} AS abonos_post_factura_total_usd, {m('saldo')} AS saldo_vivo_actual_usd,
  {m('anticipos')} AS dif_anticipos, {m('realizada')} AS dif_realizada_post, {m('no_realizada')} AS dif_no_realizada,
  {m('mes')} AS dif_no_realizada_mes, {m('anticipos + realizada + no_realizada')} AS dif_total,
  {m('base')} AS dif_dia_base, {m('mas')} AS dif_dia_plus_2pct, {m('menos')} AS dif_dia_minus_2pct"""
BILL = f"entity_id, PROVEEDOR, FACTURA, {m('VALOR')} AS VALOR, {d('GENERACIO')} AS GENERACIO, {d('VENCIMIENTO')} AS VENCIMIENTO"
SHORT_BILL = f"entity_id, PROVEEDOR, FACTURA, {m('VALOR')} AS VALOR, {d('VENCIMIENTO')} AS VENCIMIENTO"
AGED = f"{BILL}, devuelta, MES_GENERACION, DIAS_CREDITO, VENCIDA, DIAS_VENCIDA, DIAS_PARA_VENCER, PROXIMO_A_VENCER, RIESGO"
RISK_SUMS = f"{m('sum(VALOR)')} AS saldo_total, " + ", ".join(
    f"{m(f'coalesce(sum(VALOR) FILTER (WHERE RIESGO = {text(label)}), 0)')} AS {name}" for name, label in (
        ("al_dia", C.RISK_CURRENT), ("proximo_a_vencer", C.RISK_SOON), ("vencida_reciente", C.RISK_RECENT), ("vencida_critica", C.RISK_CRITICAL)))
LEDGER = f"entity_id, {d('w')} AS week_start, semana"


def dated_sum(value: str) -> str:
    return m(f"coalesce(sum({value}) FILTER (WHERE ff IS NOT NULL), 0)")


def undated_sum(value: str) -> str:
    return m(f"coalesce(sum({value}) FILTER (WHERE ff IS NULL), 0)")


CASH = f"""SELECT p.entity_id, p.week, 'Sem ' || p.week || ' (' || strftime(lunes + 7 * (p.week - 1), '%d/%m') || ' - ' || strftime(lunes + 7 * p.week - 1, '%d/%m') || ')' AS semana,
  cartera, ordinarios + extra AS op, CASE WHEN p.week = 1 THEN prestado ELSE 0 END AS inyeccion, proveedores,
  f_serv + f_arr + f_otr + n_sue + n_ss AS gastos, CASE WHEN p.week = 4 THEN pago ELSE 0 END AS deuda_mes, ini
  FROM plan p JOIN cobro USING (entity_id) JOIN semanas s ON s.entity_id = p.entity_id AND s.week = p.week
  JOIN (SELECT entity_id, sum(monto) FILTER (WHERE activo) AS prestado, sum(CAST(cuota AS DECIMAL(18,6))) FILTER (WHERE activo) AS pago FROM cuotas GROUP BY 1) q ON q.entity_id = p.entity_id
  JOIN (SELECT entity_id, saldo_inicial AS ini FROM plan WHERE week = 1) o ON o.entity_id = p.entity_id,
  (SELECT CAST(date_trunc('week', {BILL_DAY}) AS DATE) AS lunes)"""
NET = "(cartera + op + inyeccion - proveedores - gastos - deuda_mes)"


def scenario_rows(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(str, row)) + ')' for row in rows)}) s({names})"


SQL: dict[str, str] = {
    "rate_intervals_to_days": with_("trm", f"SELECT {d('fecha')} AS fecha, {m('trm', 4)} AS trm FROM trm"),
    "rate_layered_intervals_to_days": f"""SELECT strftime(fecha, '%Y-%m-%d') AS fecha, CAST(arg_max(t, (a, b, t)) AS DOUBLE) AS trm FROM (
        SELECT CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 17 = 0 THEN -3 WHEN o_orderkey % 101 = 0 THEN 900 ELSE o_orderkey % 9 END AS INTEGER) AS b, 3000 + o_orderkey % 997 AS t
        FROM orders WHERE year(o_orderdate) <> 1996 AND o_orderkey % 5 = 0)
        JOIN (SELECT CAST(unnest(generate_series(DATE '{LAYERED[0]}', DATE '{LAYERED[1]}', INTERVAL 1 DAY)) AS DATE) AS fecha) ON fecha BETWEEN a AND b GROUP BY fecha""",
    "rate_filled_calendar": with_("trm", f"""SELECT {d('x.dia')} AS fecha, {m('trm', 4)} AS trm FROM (
        SELECT CAST(unnest(generate_series((SELECT min(fecha) FROM trm), {FX_DAY}, INTERVAL 1 DAY)) AS DATE) AS dia) x ASOF JOIN trm ON x.dia >= trm.fecha"""),
    "rate_text_to_number": with_("publicadas", f"""SELECT {d('dia')} AS vigenciadesde, {d('fin')} AS vigenciahasta,
        CASE date_diff('day', DATE '1995-01-01', dia) % 4 WHEN 0 THEN '$ ' || format('{{:,.2f}}', tasa::DOUBLE)
          WHEN 1 THEN translate(format('{{:,.2f}}', tasa::DOUBLE), ',.', '.,') WHEN 2 THEN replace(CAST(CAST(tasa AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
          ELSE CAST(CAST(tasa AS DECIMAL(18,2)) AS VARCHAR) END AS valor, {m('tasa', 4)} AS trm FROM publicadas"""),
    "rate_first_needed_day": with_("rango", f"SELECT entity_id, count(*) AS facturas, {d('any_value(primero)')} AS primer_dia FROM facturas, rango GROUP BY 1"),
    "rate_newest_previous_month_end": with_("ultimas", f"""SELECT entity_id, count(*) AS facturas, {m('any_value(actual)', 4)} AS trm_actual,
        {m('any_value(ayer)', 4)} AS trm_ayer, {m('any_value(cierre)', 4)} AS trm_cierre FROM facturas, ultimas GROUP BY 1"""),
    "invoice_scan": with_("facturas", f"SELECT entity_id, factura, cliente, {d('ff')} AS fecha_factura, 'USD' AS moneda, {m('v')} AS valor_usd FROM facturas"),
    "invoice_rate_as_of": with_("con_tasa", f"SELECT entity_id, factura, {d('ff')} AS fecha_factura, {m('t', 4)} AS trm_factura FROM con_tasa"),
    "payment_rate_as_of": with_("pagos_usd trm", f"""SELECT entity_id, factura, {d('p.fecha')} AS fecha, pagos, {m('usd')} AS monto_usd, {m('trm', 4)} AS trm
        FROM (SELECT entity_id, factura, fecha, count(*) AS pagos, sum(usd) AS usd FROM pagos_usd WHERE fecha IS NOT NULL GROUP BY ALL) p ASOF LEFT JOIN trm t ON p.fecha >= t.fecha"""),
    "payments_split_by_invoice_date": with_("facturas pagos_usd", f"""SELECT f.entity_id, f.factura, {d('ff')} AS fecha_factura,
        {m("coalesce(sum(usd) FILTER (WHERE fecha < ff), 0)")} AS antes_usd,
        {m("coalesce(sum(usd) FILTER (WHERE fecha < ff AND tasa IS NOT NULL), 0)")} AS antes_usd_con_tasa,
        {m("coalesce(sum(usd * tasa) FILTER (WHERE fecha < ff), 0)")} AS antes_cop,
        {m("coalesce(sum(usd) FILTER (WHERE fecha >= coalesce(ff, DATE '0001-01-01')), 0)")} AS desde_usd,
        {m("coalesce(sum(usd) FILTER (WHERE fecha >= coalesce(ff, DATE '0001-01-01') AND tasa IS NOT NULL), 0)")} AS desde_usd_con_tasa,
        {m("coalesce(sum(usd * tasa) FILTER (WHERE fecha >= coalesce(ff, DATE '0001-01-01')), 0)")} AS desde_cop,
        {m("coalesce(sum(usd), 0)")} AS total_usd FROM facturas f LEFT JOIN pagos_usd p USING (entity_id, factura) GROUP BY f.entity_id, f.factura, ff"""),
    "payments_running_total": with_("pagos_usd", f"""SELECT entity_id, factura, {d('fecha')} AS fecha, {m('usd')} AS usd, {m('usd_t')} AS usd_con_tasa, {m('cop')} AS cop,
        {m('sum(usd) OVER w')} AS hasta_usd, {m('sum(usd_t) OVER w')} AS hasta_usd_con_tasa, {m('sum(cop) OVER w')} AS hasta_cop, {d('lead(fecha) OVER (PARTITION BY entity_id, factura ORDER BY fecha)')} AS proximo_pago
        FROM (SELECT entity_id, factura, fecha, sum(usd) AS usd, coalesce(sum(usd) FILTER (WHERE tasa IS NOT NULL), 0) AS usd_t, coalesce(sum(usd * tasa), 0) AS cop
          FROM pagos_usd WHERE fecha IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY entity_id, factura ORDER BY fecha)"""),
    "fx_summary": with_("resumen", f"SELECT {SUMMARY} FROM resumen"),
    "fx_status": with_("resumen", f"""SELECT entity_id, factura AS "Factura", cliente AS "Cliente", {m('saldo')} AS "Saldo (USD)",
        {m('realizada')} AS "Dif. Realizada (COP)", {m('mes')} AS "Efecto Mes (COP)", {m('no_realizada')} AS "Efecto Acum. (COP)" FROM resumen WHERE ff IS NOT NULL"""),
    "fx_portfolio_totals": with_("resumen", f"""SELECT entity_id, {dated_sum('saldo')} AS saldo_vivo_usd, {dated_sum('anticipos + realizada')} AS realizada_total,
        {dated_sum('mes')} AS no_realizada_mes, {dated_sum('no_realizada')} AS no_realizada_acumulada, {dated_sum('anticipos + realizada + no_realizada')} AS dif_total,
        {dated_sum('base')} AS dif_dia_base, {dated_sum('mas')} AS dif_dia_plus_2pct, {dated_sum('menos')} AS dif_dia_minus_2pct,
        {undated_sum('v')} AS sin_fecha_valor_usd, {undated_sum('antes')} AS sin_fecha_anticipos_usd, {undated_sum('saldo')} AS sin_fecha_saldo_usd FROM resumen GROUP BY 1"""),
    "fx_daily_totals": with_("denso", f"""SELECT entity_id, {d('fecha')} AS fecha, {m('trm', 4)} AS trm, {m('saldo')} AS saldo_total_usd, {m('ant')} AS dif_anticipos_total,
        {m('rea')} AS dif_realizada_post_total, {m('nor')} AS dif_no_realizada_total, {m('ant + rea + nor')} AS dif_total,
        {m('coalesce(nor - lag(nor) OVER (PARTITION BY entity_id ORDER BY fecha), 0)')} AS dif_dia_base FROM (
          SELECT e.entity_id, t.fecha, t.trm, coalesce(saldo, 0) AS saldo, coalesce(ant, 0) AS ant, coalesce(rea, 0) AS rea, coalesce(nor, 0) AS nor
          FROM (SELECT DISTINCT entity_id FROM tramos) e CROSS JOIN trm t LEFT JOIN (
            SELECT entity_id, fecha, sum(saldo) AS saldo, sum(anticipos) AS ant, sum(realizada) AS rea, sum(no_realizada) AS nor FROM denso GROUP BY 1, 2) x USING (entity_id, fecha))"""),
    "fx_daily_totals_of_shared_numbers": with_("cambios_c trm", f"""SELECT entity_id, {d('fecha')} AS fecha, {m('trm', 4)} AS trm, {m('s')} AS saldo_total_usd, {m('ant')} AS dif_anticipos_total,
        {m('rea')} AS dif_realizada_post_total, {m('nor')} AS dif_no_realizada_total, {m('ant + rea + nor')} AS dif_total,
        {m('coalesce(nor - lag(nor) OVER (PARTITION BY entity_id ORDER BY fecha), 0)')} AS dif_dia_base FROM (
          SELECT e.entity_id, t.fecha, t.trm, coalesce(c.s, 0)::DECIMAL(28,2) AS s, coalesce(c.ant, 0)::DECIMAL(38,6) AS ant, coalesce(c.rea, 0)::DECIMAL(38,6) AS rea,
            (t.trm * coalesce(c.s_t, 0)::DECIMAL(20,2) - coalesce(c.st, 0))::DECIMAL(38,6) AS nor
          FROM (SELECT DISTINCT entity_id FROM compartidas) e CROSS JOIN trm t ASOF LEFT JOIN (
            SELECT entity_id, dia, sum(s) OVER w AS s, sum(s_t) OVER w AS s_t, sum(st) OVER w AS st, sum(ant) OVER w AS ant, sum(rea) OVER w AS rea
            FROM cambios_c WINDOW w AS (PARTITION BY entity_id ORDER BY dia)) c ON c.entity_id = e.entity_id AND t.fecha >= c.dia)"""),
    "fx_invoice_series_of_one": with_("denso_n", f"""SELECT entity_id, factura, {d('fecha')} AS fecha, {m('trm', 4)} AS trm, {m('abonos')} AS abonos_post_factura_usd, {m('saldo')} AS saldo_vivo_usd,
        {m('anticipos')} AS dif_anticipos, {m('realizada')} AS dif_realizada_post, {m('no_realizada')} AS dif_no_realizada FROM denso_n WHERE factura = '{ONE_INVOICE}'"""),
    "invoice_scan_from_text": f"""SELECT 'default' AS entity_id, CAST(o_orderkey AS VARCHAR) AS factura, CAST(o_custkey AS VARCHAR) AS cliente,
        CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS fecha_factura, 'USD' AS moneda, {m('CAST(o_totalprice AS DECIMAL(18,2))')} AS valor_usd
        FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0 AND o_totalprice > 0""",
    "fx_balance_spans": with_("tramos", f"""SELECT entity_id, factura, cliente, {d('ff')} AS fecha_factura, {m('v')} AS valor_usd, {m('t', 4)} AS trm_factura,
        {d('desde')} AS desde, {d('hasta')} AS hasta, {m('antes')} AS anticipo_previo_usd, {m('abonos')} AS abonos_post_factura_usd,
        {m('greatest(v - antes - abonos, 0)')} AS saldo_vivo_usd, {m('anticipos')} AS dif_anticipos, {m('realizada')} AS dif_realizada_post FROM tramos"""),
    "fx_daily_detail_by_month": with_("denso con_tasa", f"""SELECT entity_id, mes, n * dias AS filas, {m('coalesce(abonos, 0)')} AS abonos_post_factura_usd,
        {m('coalesce(saldo, 0)')} AS saldo_vivo_usd, {m('coalesce(ant, 0)')} AS dif_anticipos, {m('coalesce(rea, 0)')} AS dif_realizada_post,
        {m('coalesce(nor, 0)')} AS dif_no_realizada, {m('coalesce(ant + rea + nor, 0)')} AS dif_total
        FROM (SELECT entity_id, count(*) AS n FROM con_tasa WHERE ff IS NOT NULL GROUP BY 1)
        CROSS JOIN (SELECT strftime(fecha, '%Y-%m') AS mes, count(*) AS dias FROM trm GROUP BY 1)
        LEFT JOIN (SELECT entity_id, strftime(fecha, '%Y-%m') AS mes, sum(abonos) AS abonos, sum(saldo) AS saldo, sum(anticipos) AS ant,
          sum(realizada) AS rea, sum(no_realizada) AS nor FROM denso GROUP BY 1, 2) USING (entity_id, mes)"""),
    "fx_invoice_series_extremes": with_("denso_n con_tasa", f"""SELECT entity_id, factura, (SELECT count(*) FROM trm) AS dias,
        {m('greatest(coalesce(alto, 0), 0)')} AS mejor_dia, {m('least(coalesce(bajo, 0), 0)')} AS peor_dia
        FROM (SELECT entity_id, factura FROM con_tasa WHERE ff IS NOT NULL) LEFT JOIN (
          SELECT entity_id, factura, max(cambio) AS alto, min(cambio) AS bajo FROM (
            SELECT entity_id, factura, no_realizada - coalesce(lag(no_realizada) OVER (PARTITION BY entity_id, factura ORDER BY fecha),
              CASE WHEN fecha = (SELECT min(fecha) FROM trm) THEN no_realizada ELSE 0 END) AS cambio FROM denso_n) GROUP BY 1, 2) USING (entity_id, factura)"""),
    "fx_daily_detail_digest": with_("filas_densas", fingerprint("filas_densas")),
    "fx_invoice_series_digest": with_("filas_densas_n", fingerprint("""(SELECT *, coalesce(no_realizada - lag(no_realizada) OVER (
        PARTITION BY entity_id, factura ORDER BY fecha), 0) AS cambio FROM filas_densas_n)""", "cambio")),
    "fx_movements": with_("movs", f"""SELECT entity_id, factura, {d('fecha')} AS fecha, {m('usd')} AS monto_usd, {m('tasa', 4)} AS tasa_monetizacion, {d('ff')} AS fecha_factura,
        {m('t', 4)} AS trm_factura, {m('coalesce(trm, first_value(trm IGNORE NULLS) OVER (PARTITION BY entity_id, factura ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))', 4)} AS trm,
        tipo AS tipo_mov, {m('dif')} AS dif_mov,
        round(CASE WHEN hi - lo < 1e-9 THEN 140.0 ELSE 60.0 + (usd::DOUBLE - lo) * 200.0 / (hi - lo) END, 6) AS size, coalesce(dif >= 0, false) AS ganancia, usd >= 50000 AS etiqueta
        FROM (SELECT *, usd * (CASE WHEN tipo = 'Anticipo' THEN t - tasa ELSE tasa - t END) AS dif,
          (min(usd) OVER w)::DOUBLE AS lo, (max(usd) OVER w)::DOUBLE AS hi FROM movs WINDOW w AS (PARTITION BY entity_id, factura, tipo))"""),
    "payables_aging": with_("edad", f"SELECT {AGED} FROM edad"),
    "payables_risk_classes": with_("edad", f"SELECT entity_id, RIESGO, count(*) AS n, {m('sum(VALOR)')} AS VALOR FROM edad GROUP BY 1, 2"),
    "payables_risk_totals": with_("edad", f"SELECT entity_id, {RISK_SUMS} FROM edad GROUP BY 1"),
    "payables_months": with_("edad", "SELECT DISTINCT MES_GENERACION FROM edad"),
    "payables_supplier_debt": with_("edad", f"SELECT entity_id, PROVEEDOR, {m('sum(VALOR)')} AS VALOR FROM edad GROUP BY 1, 2"),
    "payables_top_suppliers": with_("edad", f"""SELECT entity_id, PROVEEDOR, {m('VALOR')} AS VALOR, puesto FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY VALOR DESC, PROVEEDOR) AS puesto
        FROM (SELECT entity_id, PROVEEDOR, sum(VALOR) AS VALOR FROM edad GROUP BY 1, 2)) WHERE puesto <= 10"""),
    "payables_group_totals": with_("edad", f"""SELECT entity_id, CAST(s_nationkey AS VARCHAR) AS grupo, {RISK_SUMS},
        bool_or(DIAS_CREDITO < 60 AND VENCIDA) AS alerta_credito_corto FROM edad GROUP BY 1, 2"""),
    "payables_group_detail": with_("edad", f"SELECT {BILL}, DIAS_CREDITO, DIAS_VENCIDA, RIESGO FROM edad"),
    "payables_risk_totals_of_months": with_("edad", f"SELECT entity_id, {RISK_SUMS} FROM edad WHERE MES_GENERACION IN ('1998-03', '1999-01') GROUP BY 1"),
    "payables_bill_list_of_months": with_("edad", f"SELECT entity_id, PROVEEDOR, FACTURA, {m('VALOR')} AS VALOR, {d('VENCIMIENTO')} AS VENCIMIENTO, RIESGO FROM edad WHERE MES_GENERACION IN ('1998-03', '1999-01')"),
    "payables_chosen_detail_in_order": with_("edad", f"""SELECT {BILL}, DIAS_CREDITO, DIAS_VENCIDA, RIESGO,
        row_number() OVER (PARTITION BY PROVEEDOR ORDER BY RIESGO, VENCIMIENTO, entity_id, FACTURA, VALOR) AS puesto FROM edad
        WHERE PROVEEDOR IN ({', '.join(map(text, CHOSEN_SUPPLIERS))}) AND RIESGO IN ({', '.join(map(text, CHOSEN_RISKS))})"""),
    "payables_bills_from_text": with_("hoja", f"""SELECT 'default' AS entity_id, 'P' || p AS PROVEEDOR, CAST(k AS VARCHAR) AS FACTURA, {m('v')} AS VALOR,
        {d('g')} AS GENERACIO, {d('ve')} AS VENCIMIENTO FROM hoja WHERE motivo IS NULL"""),
    "payables_bills_from_files": with_("archivos", f"""SELECT 'default' AS entity_id, 'P' || p AS PROVEEDOR, CAST(k AS VARCHAR) AS FACTURA, {m('v')} AS VALOR, {d('g')} AS GENERACIO, {d('ve')} AS VENCIMIENTO,
        CASE WHEN k % 4 = 3 THEN 'Tubo ' || n || '" pvc' WHEN k % 4 = 0 AND n % 2 = 0 THEN 'dos,' || chr(10) || 'renglones "' || n || '"' WHEN k % 4 = 0 THEN CAST(n AS VARCHAR) END AS NOTA,
        CASE WHEN k % 4 = 1 THEN q END AS CANTIDAD FROM archivos WHERE motivo IS NULL AND k % 4 <> 2"""),
    "payables_rejects_of_files": with_("archivos", """SELECT ['a', 'b', 'c', 'd'][CAST(k % 4 + 1 AS BIGINT)] AS carpeta, motivo, count(*) AS filas FROM archivos WHERE motivo IS NOT NULL AND k % 4 <> 2 GROUP BY ALL
        UNION ALL SELECT 'c', 'faltan columnas: VENCIMIENTO', 1"""),
    "payables_rows_that_go": with_("hoja", "SELECT motivo, count(*) AS filas FROM hoja WHERE motivo IS NOT NULL GROUP BY 1"),
    "payables_short_credit_overdue": with_("edad", f"SELECT {AGED} FROM edad WHERE DIAS_CREDITO < 60 AND VENCIDA"),
    "payables_payment_form": with_("edad", f"SELECT {SHORT_BILL}, false AS PAGAR, RIESGO FROM edad"),
    "payables_payment_file": with_("edad", f"""SELECT {BILL}, devuelta, DIAS_CREDITO FROM edad
        WHERE FACTURA IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')"""),
    "payables_open_bills": with_("abiertas", f"SELECT {BILL}, devuelta FROM abiertas"),
    "payables_overdue_share": with_("deuda", f"""SELECT entity_id, {m('total')} AS total_cxp, {m('vencido')} AS total_vencido,
        round(CASE WHEN total > 0 THEN vencido::DOUBLE / total::DOUBLE ELSE 0.0 END, 6) AS porcentaje_vencido FROM deuda"""),
    "cash_payables_by_week": with_("semanas", f"""SELECT entity_id, week, {d('lunes + 7 * (week - 1)')} AS inicio, {d('lunes + 7 * week - 1')} AS fin,
        'Sem ' || week || ' (' || strftime(lunes + 7 * (week - 1), '%d/%m') || ' - ' || strftime(lunes + 7 * week - 1, '%d/%m') || ')' AS semana, {m('proveedores')} AS proveedores
        FROM semanas, (SELECT CAST(date_trunc('week', {BILL_DAY}) AS DATE) AS lunes)"""),
    "cash_weekly_collection": with_("cobro", f"SELECT entity_id, {m('cartera')} AS cartera_usd FROM cobro"),
    "cash_flow_four_weeks": with_("plan cobro semanas cuotas", f"""SELECT entity_id, week, semana,
        {m(f'ini + sum({NET}) OVER w - {NET}')} AS saldo_inicial, {m('cartera')} AS cartera_usd, {m('op')} AS ingresos_op, {m('inyeccion')} AS inyeccion_financiera,
        {m('proveedores')} AS proveedores, {m('gastos')} AS gastos_op, {m('deuda_mes')} AS pago_deuda, {m(NET)} AS flujo_neto, {m(f'ini + sum({NET}) OVER w')} AS saldo_final
        FROM ({CASH}) WINDOW w AS (PARTITION BY entity_id ORDER BY week)"""),
    "cash_weekly_close": with_("cierres libro", f"""SELECT {LEDGER}, {m('entra')} AS ingresos_reales, {m('sale')} AS egresos_reales, {m('neto')} AS flujo_neto_real
        FROM cierres c WHERE NOT EXISTS (SELECT 1 FROM libro l WHERE l.entity_id = c.entity_id AND l.w = c.w)"""),
    "cash_closed_flag": with_("cierres libro", f"""SELECT DISTINCT entity_id, EXISTS (SELECT 1 FROM libro l WHERE l.entity_id = c.entity_id
        AND l.w = CAST(date_trunc('week', {BILL_DAY}) AS DATE) - 7) AS cerrada FROM cierres c"""),
    "cash_ledger_history": with_("cierres", f"""SELECT entity_id, {d('w')} AS week_start, semana AS "Semana", {m('entra')} AS "Ingresos Reales", {m('sale')} AS "Egresos Reales",
        {m('neto')} AS "Flujo Neto Real" FROM cierres"""),
    "cash_ledger_after_repeated_closes": with_("cierres", f"SELECT {LEDGER}, {m('entra')} AS ingresos_reales, {m('sale')} AS egresos_reales, {m('neto')} AS flujo_neto_real FROM cierres"),
    "cash_plan_from_documents": with_("plan", f"""SELECT entity_id, week, {m("(SELECT max(saldo_inicial) FROM plan p WHERE p.entity_id = plan.entity_id)")} AS saldo_inicial,
        {", ".join(f"{m(name)} AS {name}" for name in ("ordinarios", "extra", "f_serv", "f_arr", "f_otr", "n_sue", "n_ss"))} FROM plan"""),
    "cash_ledger_from_documents": with_("libro", f"SELECT {LEDGER}, {m('entra')} AS ingresos_reales, {m('sale')} AS egresos_reales, {m('neto')} AS flujo_neto_real FROM libro"),
    "cash_documents_that_go": """SELECT '{"entity_id": "n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '", "S1": ' ELSE '", "S1": {"extra": "mucho"}}' END AS documento FROM nation""",
    "cash_ledger_totals": with_("libro", f"SELECT entity_id, {m('sum(entra)')} AS total_ingresos, {m('sum(sale)')} AS total_egresos, {m('sum(neto)')} AS saldo_neto FROM libro GROUP BY 1"),
    "statement_last_number": with_("filas", f"""SELECT entity_id, row_seq, celda, texto, {last_number('texto')} AS numero FROM (
        SELECT entity_id, r AS row_seq, 0 AS celda, etiqueta AS texto FROM filas UNION ALL SELECT entity_id, r, 1, nota FROM filas UNION ALL SELECT entity_id, r, 2, importe FROM filas)"""),
    "document_last_number": f"SELECT doc_id, {last_number('text')} AS ultimo_numero FROM documents",
    "statement_items": with_("partidas", "SELECT * FROM partidas"),
    "statement_items_from_files": with_("partidas_m", "SELECT * FROM partidas_m"),
    "statement_items_long": with_("partidas", "UNPIVOT partidas ON COLUMNS(* EXCLUDE entity_id) INTO NAME concepto VALUE valor"),
    "statement_ratios": with_("partidas", f"SELECT entity_id, {RATIO_LIST} FROM partidas"),
    "working_capital_days": with_("dias_e", "SELECT entity_id, round(dso, 6) AS dso, round(dio, 6) AS dio, round(dpo, 6) AS dpo, round(dio + dso - dpo, 6) AS ccc FROM dias_e"),
    "executive_fx_headline": with_("resumen", f"SELECT entity_id, {m('sum(saldo)')} AS total_usd, {m('sum(mes)')} AS pnl_mes, {m('sum(no_realizada)')} AS pnl_total FROM resumen WHERE ff IS NOT NULL GROUP BY 1"),
    "executive_top_invoices": with_("resumen", f"""SELECT entity_id, factura, cliente, {d('ff')} AS fecha_factura, {m('saldo')} AS saldo_vivo_actual_usd, {m('mes')} AS dif_no_realizada_mes,
        {m('no_realizada')} AS dif_no_realizada, row_number() OVER (PARTITION BY entity_id ORDER BY saldo DESC, factura) AS puesto FROM resumen WHERE ff IS NOT NULL QUALIFY puesto <= 10"""),
    "executive_summary": with_("resumen deuda dias_e", f"""SELECT entity_id, total_usd, pnl_mes, pnl_total, {m('total')} AS total_cxp, {m('vencido')} AS total_vencido,
        round(CASE WHEN total > 0 THEN vencido::DOUBLE / total::DOUBLE ELSE 0.0 END, 6) AS porcentaje_vencido, {RATIO_LIST},
        round(dso, 6) AS dso, round(dio, 6) AS dio, round(dpo, 6) AS dpo, round(dio + dso - dpo, 6) AS ccc
        FROM (SELECT entity_id, {m('sum(saldo)')} AS total_usd, {m('sum(mes)')} AS pnl_mes, {m('sum(no_realizada)')} AS pnl_total FROM resumen WHERE ff IS NOT NULL GROUP BY 1)
        FULL JOIN deuda USING (entity_id) FULL JOIN (SELECT p.*, dso, dio, dpo FROM partidas_e p JOIN dias_e USING (entity_id)) USING (entity_id)"""),
    "loan_installment": f"SELECT c_custkey, round({installment('c_acctbal', '((c_custkey % 4) * 0.06::DOUBLE)', '(c_custkey % 12)')}, 6) AS cuota FROM customer",
    "loan_pricing": with_("cuotas", f"""SELECT entity_id, tipo, {m('monto')} AS monto, round(tasa, 6) AS tasa_ea, meses, activo, {m('monto')} AS desembolso, round(cuota, 6) AS cuota FROM cuotas"""),
    "loan_credit_rates": f"""SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'credito' AS tipo, {m('c_acctbal')} AS monto, round(tasa, 6) AS tasa_ea, meses, true AS activo,
        {m('c_acctbal')} AS desembolso, round({installment('c_acctbal', 'tasa', 'meses')}, 6) AS cuota
        FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 0.18::DOUBLE ELSE 0.125::DOUBLE + 0.05::DOUBLE END AS tasa, c_custkey % 6 + 1 AS meses FROM customer)""",
    "loan_leaseback_assets": f"""SELECT entity_id, 'leaseback' AS tipo, {m('monto')} AS monto, 0.165::DOUBLE AS tasa_ea, 84 AS meses, true AS activo, {m('monto')} AS desembolso,
        round({installment('monto', '0.165::DOUBLE', '84')}, 6) AS cuota FROM (SELECT p_brand AS entity_id, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS monto FROM part GROUP BY 1)""",
    "scenario_spreads": with_("resumen ultimas", f"""SELECT entity_id, {m('s.spread', 4)} AS spread, {m('saldo')} AS saldo_vivo_usd, {m('saldo * (actual - ayer)')} AS dif_dia_base,
        {m('saldo * CAST(actual * (1 + s.spread) - ayer AS DECIMAL(18,6))')} AS dif_dia_plus, {m('saldo * CAST(actual * (1 - s.spread) - ayer AS DECIMAL(18,6))')} AS dif_dia_minus
        FROM (SELECT entity_id, sum(saldo)::DECIMAL(20,2) AS saldo FROM resumen WHERE ff IS NOT NULL GROUP BY 1), ultimas, {scenario_rows([(s,) for s in SPREADS], 'spread')}"""),
    "scenario_loans": with_("prestamos", f"""SELECT entity_id, tipo, {m('monto')} AS monto, s.tasa_ea::DOUBLE AS tasa_ea, s.meses AS meses,
        round({installment('monto', 's.tasa_ea::DOUBLE', 's.meses')}, 6) AS cuota FROM prestamos, {scenario_rows(LOAN_TERMS, 'tasa_ea, meses')}"""),
    "scenario_cash_cycle": with_("dias_e", f"""SELECT entity_id, round(ventas, 6) AS ventas_anuales, round(dso, 6) AS dso, round(dio, 6) AS dio, round(dpo, 6) AS dpo, menos_dso::DOUBLE AS menos_dso, mas_dpo::DOUBLE AS mas_dpo,
        round(CASE WHEN dso IS NOT NULL THEN greatest(dso - menos_dso, 0.0) END, 6) AS dso_nuevo, round(dpo + mas_dpo, 6) AS dpo_nuevo, round(dio + dso - dpo, 6) AS ccc,
        round(dio + greatest(dso - menos_dso, 0.0) - (dpo + mas_dpo), 6) AS ccc_nuevo, round(dso - greatest(dso - menos_dso, 0.0) + mas_dpo, 6) AS dias_ganados,
        round(ventas / 365, 6) AS ventas_diarias, round((dso - greatest(dso - menos_dso, 0.0) + mas_dpo) * ventas / 365, 6) AS caja_liberada
        FROM dias_e, {scenario_rows(CYCLE_STEPS, 'menos_dso, mas_dpo')}"""),
}

# The same questions over changed tables.
SQL |= {
    f"{name}_before_the_curve": SQL[name].replace(TABLES["rango"], f"SELECT DATE '{YOUNG_CURVE}' AS primero") for name in ("fx_summary", "fx_movements")
} | {"payables_open_bills_without_numbers": SQL["payables_open_bills"].replace(
    "CAST(l_orderkey AS VARCHAR) AS FACTURA", "CASE WHEN l_orderkey % 43 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS FACTURA")}
