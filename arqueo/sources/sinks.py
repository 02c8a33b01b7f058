"""Writers. Paths are given by the caller and live in shared storage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.plans.cashflow import not_yet_closed
from arqueo.plans.payables import payment_file
from arqueo.schemas import ENTITY
from arqueo.session import new_table_path, read_again


def export_fx(path: str, summary: DataFrame, series: DataFrame | None = None, detail: DataFrame | None = None,
              format: str = "parquet", files_per_month: int = 8) -> None:
    """Three tables under one folder; the daily detail is split into months. Series and detail may be absent.

    The detail is shuffled by month and bucket of invoice first, so a month has ``files_per_month`` files
    at most and is not in a single task unless that is 1.
    """
    summary.write.mode("overwrite").format(format).save(f"{path}/detalle_actual")
    if series is not None:
        series.write.mode("overwrite").format(format).save(f"{path}/serie_total")
    if detail is not None:
        by_month = detail.withColumn("mes", F.date_format("fecha", "yyyy-MM"))
        bucket = F.pmod(F.xxhash64(ENTITY, "factura", "cliente", "valor_usd"), F.lit(files_per_month))
        by_month = by_month.repartition("mes", bucket)
        by_month.write.mode("overwrite").partitionBy("mes").format(format).save(f"{path}/detalle_diario")


def write_rates(path: str, rates: DataFrame) -> None:
    """Land the daily rates once, so that later jobs read a small table."""
    rates.write.mode("overwrite").parquet(path)


def landed_rates(rates: DataFrame) -> DataFrame:
    """The daily rates written to the shared folder and read back. Jobs that take them scan their invoices and payments
    for their own work only, and not again for the range of the rates."""
    path = new_table_path(rates.sparkSession)
    write_rates(path, rates)
    return read_again(rates.sparkSession, path, rates)


def write_payment_file(path: str, aged: DataFrame, selection: DataFrame) -> None:
    payment_file(aged, selection).write.mode("overwrite").option("header", True).csv(path)


def save_plan(path: str, plan: DataFrame) -> None:
    """Replace the plan of the companies in ``plan`` and leave the others as they are."""
    (
        plan.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ENTITY).parquet(path)
    )


def append_closes(path: str, closes: DataFrame, ledger: DataFrame) -> None:
    """Add the weeks that are not in the ledger yet. Of two closes of one week the one with the smaller net flow counts, then
    the smaller income.

    The ledger has a partition per company and week, and a commit replaces the partitions it writes. So a repeated run, a retry
    after a commit that broke off, and a second writer that did not see the first leave one row per company and week; of two
    writers at the same time the later commit counts. `read_ledger` reads it back.
    """
    order = F.struct("flujo_neto_real", "ingresos_reales", "egresos_reales", "semana")
    rows = F.struct(*closes.columns)
    single = closes.groupBy(ENTITY, "week_start").agg(F.min_by(rows, order).alias("c")).select("c.*")
    (
        not_yet_closed(single, ledger).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(ENTITY, "week_start").parquet(path)
    )


def save_plan_documents(path: str, documents: DataFrame) -> None:
    """One JSON object per company and line, as `read_plan_documents` takes them (with ``multi_line=False``)."""
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.mode("overwrite").text(path)
