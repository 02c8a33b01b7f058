"""Executive roll-up: receivables, payables and ratios on one row per entity."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.plans.fx import AsOf
from arqueo.plans.payables import overdue_share
from arqueo.plans.statements import working_capital_days
from arqueo.schemas import COP_AMOUNT, ENTITY, USD_TOTAL


def fx_headline(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("fecha_factura").isNotNull()).groupBy(ENTITY).agg(
        F.sum("saldo_vivo_actual_usd").cast(USD_TOTAL).alias("total_usd"),
        F.sum("dif_no_realizada_mes").cast(COP_AMOUNT).alias("pnl_mes"),
        F.sum("dif_no_realizada").cast(COP_AMOUNT).alias("pnl_total"),
    )


def top_invoices(summary: DataFrame, size: int = C.TOP_SIZE) -> DataFrame:
    """Largest open balances per entity with both effects; ties go by invoice number, then client.

    Spark cuts each input partition to ``size`` rows per entity before the shuffle.
    """
    ranked = W.partitionBy(ENTITY).orderBy(F.desc("saldo_vivo_actual_usd"), "factura", "cliente", "fecha_factura")
    return (
        summary.where(F.col("fecha_factura").isNotNull())
        .select(ENTITY, "factura", "cliente", "fecha_factura", "saldo_vivo_actual_usd", "dif_no_realizada_mes", "dif_no_realizada")
        .withColumn("puesto", F.row_number().over(ranked)).where(F.col("puesto") <= size)
    )


def executive_summary(summary: DataFrame, bills: DataFrame, items: DataFrame, as_of: AsOf) -> DataFrame:
    """``summary`` from `fx_summary`, ``items`` from `statement_items`; one row per entity found in any."""
    payables = overdue_share(bills, as_of)
    statements = working_capital_days(items, payables, ratios=True)
    return fx_headline(summary).join(payables, ENTITY, "full").join(statements, ENTITY, "full")
