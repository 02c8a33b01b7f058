"""Payments reduced to one row per invoice number and day, before anything is joined to them.

An invoice number may own a large share of the payments. The first aggregate combines on the
map side, so what reaches one task for such a number is bounded by its distinct payment days.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arqueo.schemas import COP_AMOUNT, ENTITY, USD_TOTAL

INVOICE_KEY = (ENTITY, "factura")
_SUMS = ("usd", "usd_con_tasa", "cop")


def daily_payments(monetizaciones: DataFrame) -> DataFrame:
    """Per invoice number and day: USD paid, USD paid at a known rate, COP at that rate.

    Payments without a number match no invoice and are left out. The day may be NULL.
    """
    usd, rate = F.col("monto_usd"), F.col("tasa_monetizacion")
    return (
        monetizaciones.where(F.col("factura").isNotNull())
        .groupBy(*INVOICE_KEY, "fecha")
        .agg(
            F.coalesce(F.sum(usd), F.lit(0)).cast(USD_TOTAL).alias("usd"),
            F.coalesce(F.sum(F.when(rate.isNotNull(), usd)), F.lit(0)).cast(USD_TOTAL).alias("usd_con_tasa"),
            F.coalesce(F.sum(rate * usd), F.lit(0)).cast(COP_AMOUNT).alias("cop"),
        )
    )


def split_by_invoice_date(facturas: DataFrame, daily: DataFrame) -> DataFrame:
    """Totals before (``antes_*``) and from (``desde_*``) each invoice date, plus ``total_usd``.

    One row per distinct (entity, number, date). Invoice dates and payment days are laid on one
    time line per number and summed along it, so invoices that share a number do not multiply
    the payments. ``primer_pago`` is the first payment day at or after the date. Payments
    without a day count in ``total_usd`` only.
    """
    dates = (
        facturas.where(F.col("factura").isNotNull())
        .select(*INVOICE_KEY, F.col("fecha_factura").alias("fecha"))
        .distinct()
        .withColumn("pago", F.lit(False))
    )
    line = dates.unionByName(daily.withColumn("pago", F.lit(True)), allowMissingColumns=True)
    ordered = W.partitionBy(*INVOICE_KEY).orderBy("fecha", "pago")
    past = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    number = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # all rows, in the same pass as the others
    dated = F.col("fecha").isNotNull()

    def total(name: str, window, kind) -> Column:
        return F.coalesce(F.sum(F.when(dated, F.col(name))).over(window), F.lit(0)).cast(kind)

    kinds = {"usd": USD_TOTAL, "usd_con_tasa": USD_TOTAL, "cop": COP_AMOUNT}
    sums = {f"antes_{name}": total(name, past, kinds[name]) for name in _SUMS}
    sums |= {f"__dated_{name}": total(name, number, kinds[name]) for name in _SUMS}
    sums["total_usd"] = F.coalesce(F.sum("usd").over(number), F.lit(0)).cast(USD_TOTAL)
    # Days rise, so the next payment that has one is the earliest; a frame up to the end would be read again for every row.
    sums["primer_pago"] = F.expr(
        f"lead(CASE WHEN pago THEN fecha END) IGNORE NULLS OVER (PARTITION BY {', '.join(INVOICE_KEY)} ORDER BY fecha, pago)")
    after = [
        (F.col(f"__dated_{name}") - F.col(f"antes_{name}")).cast(kinds[name]).alias(f"desde_{name}") for name in _SUMS
    ]
    return (
        line.withColumns(sums).where(~F.col("pago"))
        .select(
            *INVOICE_KEY, F.col("fecha").alias("fecha_factura"),
            *(f"antes_{name}" for name in _SUMS), *after, "total_usd", "primer_pago",
        )
    )


def payment_curve(daily: DataFrame) -> DataFrame:
    """Running totals per invoice number at each payment day, with the day of the next payment.

    ``daily`` must hold dated payments only.
    """
    ordered = W.partitionBy(*INVOICE_KEY).orderBy("fecha")
    past = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    kinds = {"usd": USD_TOTAL, "usd_con_tasa": USD_TOTAL, "cop": COP_AMOUNT}
    running = {f"hasta_{name}": F.sum(name).over(past).cast(kinds[name]) for name in _SUMS}
    return daily.withColumns(running | {"proximo_pago": F.lead("fecha").over(ordered)})
