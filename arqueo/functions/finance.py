"""Loan, ratio and working-capital arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arqueo import constants as C


def monthly_rate(annual_rate: Column) -> Column:
    return F.pow(1 + annual_rate, F.lit(1.0 / 12.0)) - 1


def installment(amount: Column, annual_rate: Column, months: Column) -> Column:
    """Level payment of a loan; 0 when there is no amount or no term, straight division at rate 0."""
    principal, term, rate = amount.cast("double"), months.cast("double"), monthly_rate(annual_rate)
    growth = F.pow(1 + rate, term)
    return (
        F.when((principal <= 0) | (term <= 0), F.lit(0.0))
        .when(rate == 0, F.try_divide(principal, term))
        .otherwise(F.try_divide(principal * (rate * growth), growth - 1))
    )


def effective_rate(kind: Column, fixed: Column, reference: Column, spread: Column) -> Column:
    """Either the fixed annual rate, or the reference rate plus a spread."""
    return F.when(kind == C.RATE_FIXED, fixed).otherwise(reference + spread)


def positive_or_one(value: Column) -> Column:
    return F.when(value > 0, value).otherwise(F.lit(1.0))


def ratio_columns(items: dict[str, Column]) -> dict[str, Column]:
    """Ten ratios from statement line items (name to column)."""
    current_assets, current_debt = items["Activo Corriente"], items["Pasivo Corriente"]
    net, sales = items["Utilidad Neta"], positive_or_one(items["Ingresos"])
    short_base, asset_base = positive_or_one(current_debt), positive_or_one(items["Activo Total"])
    return {
        "Razón Corriente": current_assets / short_base,
        "Prueba Ácida": (current_assets - items["Inventarios"]) / short_base,
        "Capital de Trabajo": current_assets - current_debt,
        "Nivel Endeudamiento": items["Pasivo Total"] / asset_base,
        "Cobertura Intereses": items["Utilidad Operativa"] / positive_or_one(items["Gastos Financieros"]),
        "Margen Bruto": items["Utilidad Bruta"] / sales,
        "Margen Operativo": items["Utilidad Operativa"] / sales,
        "Margen Neto": net / sales,
        "ROA": net / asset_base,
        "ROE": net / positive_or_one(items["Patrimonio"]),
    }


def turnover_days(stock: Column, flow: Column, year: int = C.RATIO_DAYS_PER_YEAR) -> Column:
    """Days of ``flow`` held in ``stock``; NULL when the flow is zero."""
    return F.try_divide(stock.cast("double"), flow.cast("double")) * year


def cash_cycle(dio: Column, dso: Column, dpo: Column) -> Column:
    return dio + dso - dpo


def released_cash(days_gained: Column, yearly_sales: Column, year: int = C.SALES_DAYS_PER_YEAR) -> Column:
    return days_gained * (yearly_sales.cast("double") / year)
