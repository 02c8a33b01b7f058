"""Business defaults. Every job takes them as parameters; these are the values used when none is given."""

from decimal import Decimal

# --- Fixed values: defaults of the calculations -----------------------------
SPREAD = Decimal("0.02")
WEEKLY_COLLECTION_SHARE = Decimal("0.20")
CRITICAL_AFTER_DAYS = 30
DUE_SOON_DAYS = 7
SHORT_CREDIT_DAYS = 60
TOP_SIZE = 10
SALES_DAYS_PER_YEAR = 365
RATIO_DAYS_PER_YEAR = 360
CASH_WEEKS = 4
POINT_SIZE_MIN = 60.0
POINT_SIZE_MAX = 260.0
POINT_SIZE_FLAT = 140.0
POINT_SIZE_TOLERANCE = 1e-9
CURRENCY = "USD"

# --- Fixed values: class labels ---------------------------------------------
RISK_CRITICAL = "🔴 Vencida Crítica (>30d)"
RISK_RECENT = "🟠 Vencida Reciente (1-30d)"
RISK_SOON = "🟡 Próximo a Vencer (1-7d)"
RISK_CURRENT = "🟢 Al día (>7d)"
MOVE_ADVANCE = "Anticipo"
MOVE_POST = "Post-factura"
RATE_FIXED = "Fija"
LOAN_CREDIT = "credito"
LOAN_LEASEBACK = "leaseback"

# --- Fixed values: column contracts -----------------------------------------
INVOICE_COLUMNS = ("factura", "cliente", "fecha_factura", "moneda", "valor_usd")
PAYMENT_COLUMNS = ("fecha", "factura", "monto_usd", "tasa_monetizacion")
BILL_COLUMNS = ("PROVEEDOR", "VALOR", "FACTURA", "GENERACIO", "VENCIMIENTO")
BILL_HEADER_ALIASES = {"GENERACION": "GENERACIO", "FECHA_GENERACION": "GENERACIO"}

# --- Fixed values: statement line items and the texts that announce them ------
STATEMENT_KEYWORDS = {
    "Efectivo": ("EFECTIVO Y EQUIVALENTES", "CAJA Y BANCOS"),
    "Cuentas por Cobrar": ("CTAS POR COBRAR COMER", "CLIENTES", "DEUDORES COMERCIALES"),
    "Inventarios": ("INVENTARIOS", "MERCANCIAS"),
    "Activo Corriente": ("ACTIVO CORRIENTE", "ACTIVOS CORRIENTES"),
    "Activo Total": ("TOTAL ACTIVO", "TOTAL ACTIVOS"),
    "Pasivo Corriente": ("PASIVO CORRIENTE", "TOTAL PASIVO CORRIENTE"),
    "Pasivo Total": ("TOTAL PASIVO", "TOTAL PASIVOS"),
    "Patrimonio": ("TOTAL PATRIMONIO", "PATRIMONIO TOTAL"),
    "Ingresos": ("INGRESOS DE ACTIVIDADES ORDINARIAS", "INGRESOS OPERACIONALES", "VENTAS"),
    "Costo de Venta": ("COSTO DE VENTA", "COSTOS DE VENTAS"),
    "Utilidad Bruta": ("GANANCIA BRUTA", "UTILIDAD BRUTA"),
    "Gastos de Administración": (
        "GASTOS DE ADMINISTRACIÓN", "GASTOS ADMINISTRATIVOS", "GASTOS DE VENTAS Y DISTRIBUCION",
    ),
    "Utilidad Operativa": ("GANANCIA OPERATIVA", "UTILIDAD OPERATIVA"),
    "Gastos Financieros": ("GASTOS FINANCIEROS",),
    "Utilidad Neta": ("UTILIDAD DEL PERIODO", "GANANCIA NETA", "UTILIDAD NETA", "GANANCIA  (PÉRDIDA)"),
}
