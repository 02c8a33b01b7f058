"""Pricing of credits and leasebacks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.functions import finance
from arqueo.schemas import ENTITY, LOANS, MONEY


def asset_totals(assets: DataFrame) -> DataFrame:
    return assets.groupBy(ENTITY).agg(F.sum("valor").cast(MONEY).alias("monto"))


def leaseback_loans(assets: DataFrame, annual_rate: float, years: int, active: bool = True) -> DataFrame:
    """One leaseback per entity over the total of its assets."""
    return asset_totals(assets).select(
        ENTITY, F.lit(C.LOAN_LEASEBACK).alias("tipo"), "monto", F.lit(float(annual_rate)).alias("tasa_ea"),
        F.lit(years * 12).alias("meses"), F.lit(active).alias("activo"),
    )


def credit_loans(requests: DataFrame, reference_rate: float, active: bool = True) -> DataFrame:
    """Credits from (entity_id, monto, tipo_tasa, tasa_fija, spread, meses) requests."""
    rate = finance.effective_rate(F.col("tipo_tasa"), F.col("tasa_fija"), F.lit(float(reference_rate)), F.col("spread"))
    return requests.select(
        ENTITY, F.lit(C.LOAN_CREDIT).alias("tipo"), F.col("monto").cast(MONEY).alias("monto"),
        rate.cast("double").alias("tasa_ea"), F.col("meses").cast("int").alias("meses"), F.lit(active).alias("activo"),
    )


def price_loans(loans: DataFrame) -> DataFrame:
    """Installment of each loan and what it brings into and takes out of the cash flow. No shuffle."""
    return loans.select(
        *LOANS.fieldNames(),
        F.col("monto").alias("desembolso"),
        finance.installment(F.col("monto"), F.col("tasa_ea"), F.col("meses")).alias("cuota"),
    )
