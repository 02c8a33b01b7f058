"""Daily rates from validity intervals, and the as-of lookup against them.

A rate table has at most one row per calendar day, so its size is bounded by the calendar
(about 9,000 rows for 25 years, 3.7 million for every day the DATE type knows) and does not grow with the
invoices. That bound is what allows the single ordered window here, and lets Spark broadcast the table by its size.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arqueo.functions.text import rate_number
from arqueo.schemas import RATE


def _by_day():
    return W.orderBy("fecha")


def first_needed_day(facturas: DataFrame, monetizaciones: DataFrame, as_of: Column) -> Column:
    """Earliest invoice or payment day; the as-of day when there is neither. A scalar subquery."""
    invoice = facturas.agg(F.min("fecha_factura")).scalar()
    payment = monetizaciones.agg(F.min("fecha")).scalar()
    return F.coalesce(F.least(invoice, payment), as_of)


def _no_rates() -> Column:
    return F.raise_error(F.lit("no usable rate source for the range"))


def daily_rates(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """One rate per day of ``[start, end]`` from the first source, by ``prioridad``, that can be used.

    Intervals are cut to the range. A source with an unreadable or
    missing rate in the range, or with an unreadable date anywhere, is passed over whole; `rate_rejects` lists
    why. Days covered twice take the record that starts last. No usable source is an error for
    whatever reads the rates, even if it would look up no day.
    """
    undated = F.col("vigenciadesde").isNull() | F.col("vigenciahasta").isNull()
    in_range = (F.col("vigenciadesde") <= F.col("vigenciahasta")) & (F.col("desde") <= F.col("hasta"))
    found = intervals.select(
        "prioridad", "vigenciadesde", "vigenciahasta", rate_number(F.col("valor")).alias("trm"),
        F.greatest("vigenciadesde", start).alias("desde"), F.least("vigenciahasta", end).alias("hasta"),
    ).withColumn("__undated", undated).where(F.col("__undated") | in_range)
    usable = (
        found.groupBy("prioridad")
        .agg(F.bool_and(~F.col("__undated") & F.col("trm").isNotNull()).alias("legible"))
        .where("legible").agg(F.min("prioridad")).scalar()
    )
    days = _latest_start(found.where(~F.col("__undated") & (F.col("prioridad") == usable)), start, end)
    # A row that never comes out: asking for it is what raises the error.
    guard = intervals.sparkSession.range(1).where(F.coalesce(usable, _no_rates().cast("int")).isNull())
    none = guard.select(*(F.lit(None).cast(field.dataType).alias(field.name) for field in days.schema.fields))
    return days.unionByName(none)


# Stretches of 2^k days, k up to here, hold every day the DATE type knows.
_LEVELS = 22
_ORIGIN = "DATE'0001-01-01'"


def _latest_start(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Days of ``[start, end]`` with the rate of the interval (``desde`` to ``hasta``) around them that starts last, then ends last.

    An interval is cut into the few stretches of 2^k days, at multiples of 2^k, that make it up: at most two of each size, however
    long it is. The best interval of each stretch is an aggregate, and a day asks the one stretch of each size that holds it. So
    long intervals on top of each other cost their number times the logarithm of their length and not their days.
    """
    low, high = "shiftright(__desde + shiftleft(1, k) - 1, k)", "shiftright(__hasta, k)"
    cut = (
        f"filter(flatten(transform(sequence(0, {_LEVELS}), k -> array("
        f"named_struct('k', k, 'n', if({low} < {high} AND {low} % 2 = 1, {low}, null)),"
        f"named_struct('k', k, 'n', if({high} % 2 = 1 AND {low} + {low} % 2 < {high}, {high} - 1, null))))), s -> s.n IS NOT NULL)"
    )
    numbered = intervals.withColumns({"__desde": F.expr(f"datediff(desde, {_ORIGIN})"), "__hasta": F.expr(f"datediff(hasta, {_ORIGIN}) + 1")})
    best = numbered.select("trm", "vigenciadesde", "vigenciahasta", F.explode(F.expr(cut)).alias("s")).groupBy("s.k", "s.n").agg(
        F.max(F.struct("vigenciadesde", "vigenciahasta", "trm")).alias("mejor"))
    largest = best.agg(F.max("k")).scalar()
    asked = (
        intervals.sparkSession.range(1).select(F.explode(F.when(start <= end, F.sequence(start, end))).alias("fecha"))
        .select("fecha", F.expr(f"datediff(fecha, {_ORIGIN})").alias("dia"), F.explode(F.sequence(F.lit(0), F.coalesce(largest, F.lit(0)))).alias("k"))
        .select("fecha", "k", F.expr("shiftright(dia, k)").alias("n"))
    )
    return asked.join(best, ["k", "n"]).groupBy("fecha").agg(F.max("mejor").alias("mejor")).select("fecha", F.col("mejor.trm").alias("trm"))


def rate_rejects(intervals: DataFrame) -> DataFrame:
    """Intervals that discredit their source, with the reason."""
    reason = F.when(rate_number(F.col("valor")).isNull(), "valor ilegible").when(
        F.col("vigenciadesde").isNull() | F.col("vigenciahasta").isNull(), "fecha ilegible")
    return intervals.withColumn("motivo", reason).where(F.col("motivo").isNotNull())


def last_rates(rates: DataFrame, cutoff: Column) -> Column:
    """One-row struct: newest rate, the one before it, and the newest at or before ``cutoff``.

    The previous rate and the cutoff rate fall back to the newest. Meant to be read field by field.
    """
    stepped = rates.withColumn("previa", F.lag("trm").over(_by_day()))
    latest = F.coalesce(F.max_by("trm", "fecha"), _no_rates().cast(RATE))  # an empty table is an error
    return stepped.agg(
        F.struct(
            latest.alias("trm_actual"),
            F.coalesce(F.max_by("previa", "fecha"), latest).alias("trm_ayer"),
            F.coalesce(F.max_by("trm", F.when(F.col("fecha") <= cutoff, F.col("fecha"))), latest).alias("trm_cierre"),
        )
    ).scalar()


def fill_calendar(rates: DataFrame, end: Column) -> DataFrame:
    """Carry each rate forward over the days without one, up to ``end``."""
    until = F.coalesce(F.date_sub(F.lead("fecha").over(_by_day()), 1), F.greatest("fecha", end))
    return rates.withColumn("hasta", until).select(F.explode(F.sequence("fecha", "hasta")).alias("fecha"), "trm")


def rate_as_of(rows: DataFrame, date: str, rates: DataFrame, end: Column, name: str) -> DataFrame:
    """Backward as-of join: the last rate at or before ``date``, kept NULL before the first one.

    Days after ``end`` look up ``end`` itself, so the filled calendar stops there and an equi-join
    against it replaces the range condition.
    """
    calendar = fill_calendar(rates, end).select(F.col("fecha").alias("__dia"), F.col("trm").alias(name))
    lookup = F.least(F.col(date), F.when(F.col(date).isNotNull(), end))
    return rows.join(calendar, lookup == F.col("__dia"), "left").drop("__dia")
