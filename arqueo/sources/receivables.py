"""Invoices in USD and the payments made on them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo import constants as C
from arqueo.functions import text
from arqueo.schemas import ENTITY, MONETIZACIONES
from arqueo.sources import columns as col


def prepare_invoices(raw: DataFrame, currency: str = C.CURRENCY) -> DataFrame:
    """Coerce, trim, and keep the positive invoices in ``currency``."""
    col.require(raw, C.INVOICE_COLUMNS, "facturas")
    return raw.select(
        col.entity(raw), col.label(raw, "factura"), col.label(raw, "cliente"), col.date(raw, "fecha_factura"),
        col.label(raw, "moneda", upper=True), col.money(raw, "valor_usd"),
    ).where((F.col("moneda") == currency) & (F.col("valor_usd") > 0))


def invoice_rejects(raw: DataFrame, currency: str = C.CURRENCY) -> DataFrame:
    """Rows that `prepare_invoices` drops, or keeps without a date that is there but cannot be read, with the reason in ``motivo``."""
    col.require(raw, C.INVOICE_COLUMNS, "facturas")
    amount, date = col.money(raw, "valor_usd"), col.date(raw, "fecha_factura")
    given = F.coalesce(text.clean(F.col("fecha_factura").cast("string")), F.lit("")) != ""
    reason = (
        F.when(~col.label(raw, "moneda", upper=True).eqNullSafe(F.lit(currency)), "otra moneda").when(amount.isNull(), "valor_usd ilegible")
        .when(amount <= 0, "valor_usd no positivo").when(given & date.isNull(), "fecha_factura ilegible")
    )
    return raw.withColumn("motivo", reason).where(F.col("motivo").isNotNull())


def payment_rejects(raw: DataFrame) -> DataFrame:
    """Rows in which a number or date is there but cannot be read, with the columns in ``motivo``. The rows stay in the payments."""
    col.require(raw, C.PAYMENT_COLUMNS, "monetizaciones")
    parsed = {"fecha": col.date(raw, "fecha"), "monto_usd": col.money(raw, "monto_usd"), "tasa_monetizacion": col.rate(raw, "tasa_monetizacion")}
    bad = [F.when((F.coalesce(text.clean(F.col(name).cast("string")), F.lit("")) != "") & value.isNull(), name) for name, value in parsed.items()]
    return raw.withColumn("motivo", F.concat_ws(", ", *bad)).where(F.col("motivo") != "")


def prepare_payments(raw: DataFrame) -> DataFrame:
    col.require(raw, C.PAYMENT_COLUMNS, "monetizaciones")
    return raw.select(
        col.entity(raw), col.date(raw, "fecha"), col.label(raw, "factura"),
        col.money(raw, "monto_usd"), col.rate(raw, "tasa_monetizacion"),
    )


def no_payments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MONETIZACIONES)


def _read(spark: SparkSession, path: str | list[str], format: str) -> DataFrame:
    if format == "csv":
        return spark.read.option("header", True).csv(path)
    if format == "json":
        names = dict.fromkeys((ENTITY, *C.INVOICE_COLUMNS, *C.PAYMENT_COLUMNS))
        return spark.read.schema(T.StructType([T.StructField(name, T.StringType()) for name in names])).json(path)
    return spark.read.format(format).load(path)


def read_invoices(spark: SparkSession, path: str | list[str], format: str = "parquet") -> DataFrame:
    return prepare_invoices(_read(spark, path, format))


def read_payments(spark: SparkSession, path: str | list[str] | None, format: str = "parquet") -> DataFrame:
    """Payments, or an empty table of the same shape when there is no file."""
    return no_payments(spark) if path is None else prepare_payments(_read(spark, path, format))


def invoice_by_number(facturas: DataFrame, factura: str) -> DataFrame:
    return facturas.where(F.col("factura") == factura)


def dated(facturas: DataFrame) -> DataFrame:
    return facturas.where(F.col("fecha_factura").isNotNull())


def undated(facturas: DataFrame) -> DataFrame:
    return facturas.where(F.col("fecha_factura").isNull())
