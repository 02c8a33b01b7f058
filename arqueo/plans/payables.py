"""Payables: aging, risk totals, concentration, supplier groups, payment file."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.functions import aging
from arqueo.functions.dates import day, month_label
from arqueo.operators.joins import skew_join
from arqueo.plans.fx import AsOf
from arqueo.schemas import ENTITY, USD_TOTAL

DERIVED_COLUMNS = (
    "MES_GENERACION", "DIAS_CREDITO", "VENCIDA", "DIAS_VENCIDA", "DIAS_PARA_VENCER", "PROXIMO_A_VENCER", "RIESGO",
)
# The payment file drops what was derived, except the credit days.
PAYMENT_FILE_DROPS = tuple(name for name in DERIVED_COLUMNS if name != "DIAS_CREDITO")
RISK_TOTALS = {
    "al_dia": C.RISK_CURRENT, "proximo_a_vencer": C.RISK_SOON,
    "vencida_reciente": C.RISK_RECENT, "vencida_critica": C.RISK_CRITICAL,
}
BILL_KEY = (ENTITY, "FACTURA")


def payables_aging(
    bills: DataFrame, as_of: AsOf,
    critical_after: int = C.CRITICAL_AFTER_DAYS, soon_days: int = C.DUE_SOON_DAYS,
) -> DataFrame:
    """Every bill with its seven derived columns. No shuffle."""
    today, due = day(as_of), F.col("VENCIMIENTO")
    return bills.withColumns({
        "MES_GENERACION": month_label(F.col("GENERACIO")),
        "DIAS_CREDITO": aging.credit_days(F.col("GENERACIO"), due),
        "VENCIDA": aging.is_overdue(due, today),
        "DIAS_VENCIDA": aging.days_overdue(due, today),
        "DIAS_PARA_VENCER": aging.days_to_due(due, today),
        "PROXIMO_A_VENCER": aging.is_due_soon(due, today, soon_days),
        "RIESGO": aging.risk_class(due, today, critical_after, soon_days),
    })


def in_months(aged: DataFrame, months: Sequence[str] | None) -> DataFrame:
    """Bills generated in the chosen months; None keeps them all."""
    return aged if months is None else aged.where(F.col("MES_GENERACION").isin(*months))


def _risk_sums() -> list[Column]:
    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast(USD_TOTAL)

    value = F.col("VALOR")
    return [total(value).alias("saldo_total")] + [
        total(F.when(F.col("RIESGO") == label, value)).alias(name) for name, label in RISK_TOTALS.items()
    ]


def risk_totals(aged: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Total and the four class totals per entity over the chosen months."""
    return in_months(aged, months).groupBy(ENTITY).agg(*_risk_sums())


def bill_list(aged: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    return in_months(aged, months).select(ENTITY, "PROVEEDOR", "FACTURA", "VALOR", "VENCIMIENTO", "RIESGO")


def supplier_debt(aged: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    return in_months(aged, months).groupBy(ENTITY, "PROVEEDOR").agg(F.sum("VALOR").cast(USD_TOTAL).alias("VALOR"))


def top_suppliers(aged: DataFrame, months: Sequence[str] | None = None, size: int = C.TOP_SIZE) -> DataFrame:
    """Largest creditors per entity with their rank; ties go by name."""
    ranked = W.partitionBy(ENTITY).orderBy(F.desc("VALOR"), "PROVEEDOR")
    return supplier_debt(aged, months).withColumn("puesto", F.row_number().over(ranked)).where(F.col("puesto") <= size)


def choices(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, sorted: months, suppliers, risk classes or invoice numbers to pick from."""
    return rows.select(column).distinct().orderBy(column)


def supplier_group_totals(
    aged: DataFrame, groups: DataFrame, short_credit_days: int = C.SHORT_CREDIT_DAYS,
) -> DataFrame:
    """Risk totals and the short-credit alert per chosen group of suppliers.

    ``groups`` has (entity_id, grupo, PROVEEDOR). Bills are summed per supplier before they meet it.
    """
    alert = (F.col("DIAS_CREDITO") < short_credit_days) & F.col("VENCIDA")
    per_supplier = aged.groupBy(ENTITY, "PROVEEDOR").agg(*_risk_sums(), F.bool_or(alert).alias("alerta_credito_corto"))
    names = ["saldo_total", *RISK_TOTALS]
    return (
        per_supplier.join(groups.select(ENTITY, "grupo", "PROVEEDOR").distinct(), [ENTITY, "PROVEEDOR"])
        .groupBy(ENTITY, "grupo")
        .agg(
            *(F.sum(name).cast(USD_TOTAL).alias(name) for name in names),
            F.bool_or("alerta_credito_corto").alias("alerta_credito_corto"),
        )
    )


def supplier_group_detail(
    aged: DataFrame, suppliers: Sequence[str] | None = None, risks: Sequence[str] | None = None,
) -> DataFrame:
    """Bills of the chosen suppliers and classes, sorted by class and due day."""
    rows = aged if suppliers is None else aged.where(F.col("PROVEEDOR").isin(*suppliers))
    rows = rows if risks is None else rows.where(F.col("RIESGO").isin(*risks))
    return rows.select(
        ENTITY, "PROVEEDOR", "FACTURA", "VALOR", "GENERACIO", "VENCIMIENTO", "DIAS_CREDITO", "DIAS_VENCIDA", "RIESGO",
    ).orderBy("RIESGO", "VENCIMIENTO", ENTITY, "PROVEEDOR", "FACTURA")


def short_credit_overdue(aged: DataFrame, short_credit_days: int = C.SHORT_CREDIT_DAYS) -> DataFrame:
    return aged.where((F.col("DIAS_CREDITO") < short_credit_days) & F.col("VENCIDA"))


def payment_form(aged: DataFrame) -> DataFrame:
    """The list a user ticks: nothing selected yet."""
    return bill_list(aged).select(ENTITY, F.lit(False).alias("PAGAR"), "PROVEEDOR", "FACTURA", "VALOR", "VENCIMIENTO", "RIESGO")


def payment_file(aged: DataFrame, selection: DataFrame) -> DataFrame:
    """Bills whose number was ticked, without the derived columns.

    The number alone decides, so another supplier's bill with the same number comes along.
    """
    ticked = selection.select(*BILL_KEY).distinct()
    return skew_join(aged, ticked, BILL_KEY, "left_semi", null_safe=["FACTURA"]).drop(*PAYMENT_FILE_DROPS)


def open_bills(bills: DataFrame, paid: DataFrame) -> DataFrame:
    """Bills whose number is not among the paid ones. A missing number matches a missing number."""
    done = paid.select(*BILL_KEY).distinct()
    return skew_join(bills, done, BILL_KEY, "left_anti", null_safe=["FACTURA"])


def overdue_share(bills: DataFrame, as_of: AsOf) -> DataFrame:
    """Total owed per entity and the part of it past due; 0 when nothing is owed."""
    overdue = F.when(F.col("VENCIMIENTO") < day(as_of), F.col("VALOR"))
    totals = bills.groupBy(ENTITY).agg(
        F.coalesce(F.sum("VALOR"), F.lit(0)).cast(USD_TOTAL).alias("total_cxp"),
        F.coalesce(F.sum(overdue), F.lit(0)).cast(USD_TOTAL).alias("total_vencido"),
    )
    share = F.try_divide(F.col("total_vencido").cast("double"), F.col("total_cxp").cast("double"))
    return totals.withColumn("porcentaje_vencido", F.when(F.col("total_cxp") > 0, share).otherwise(F.lit(0.0)))
