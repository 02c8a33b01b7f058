"""Logical tables. Every table carries ``entity_id`` so one job serves many companies."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(18, 4)
USD_TOTAL = T.DecimalType(28, 2)
COP_AMOUNT = T.DecimalType(38, 6)

ENTITY = "entity_id"
DEFAULT_ENTITY = "default"

_S, _D = T.StringType(), T.DateType()


def _table(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


FACTURAS = _table(
    (ENTITY, _S), ("factura", _S), ("cliente", _S), ("fecha_factura", _D), ("moneda", _S), ("valor_usd", MONEY),
)
MONETIZACIONES = _table(
    (ENTITY, _S), ("fecha", _D), ("factura", _S), ("monto_usd", MONEY), ("tasa_monetizacion", RATE),
)
TRM_INTERVALOS = _table(
    ("prioridad", T.IntegerType()), ("valor", _S), ("vigenciadesde", _D), ("vigenciahasta", _D),
)
COMPRAS = _table(
    (ENTITY, _S), ("PROVEEDOR", _S), ("FACTURA", _S), ("VALOR", MONEY), ("GENERACIO", _D), ("VENCIMIENTO", _D),
    ("extras", T.MapType(_S, _S)),
)
EEFF_FILAS = _table(
    (ENTITY, _S), ("file_seq", T.StringType()), ("sheet_seq", T.IntegerType()),
    ("block_seq", T.LongType()), ("row_seq", T.LongType()),
    ("cells", T.ArrayType(_table(("raw", _S), ("num", T.DoubleType())))),
)
CASH_PLAN_INPUTS = ("ordinarios", "extra", "f_serv", "f_arr", "f_otr", "n_sue", "n_ss")
CASH_PLAN = _table(
    (ENTITY, _S), ("week", T.IntegerType()), ("saldo_inicial", MONEY), *((name, MONEY) for name in CASH_PLAN_INPUTS),
)
CASH_ACTUALS = _table(
    (ENTITY, _S), ("week_start", _D), ("semana", _S),
    ("ingresos_reales", MONEY), ("egresos_reales", MONEY), ("flujo_neto_real", MONEY),
)
LOANS = _table(
    (ENTITY, _S), ("tipo", _S), ("monto", MONEY), ("tasa_ea", T.DoubleType()),
    ("meses", T.IntegerType()), ("activo", T.BooleanType()),
)
LOAN_ASSETS = _table((ENTITY, _S), ("maquina", _S), ("valor", MONEY))
