"""The plan document (one JSON object per company) as two tables: plan by week, and ledger of closed weeks."""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo import constants as C
from arqueo.functions.dates import day
from arqueo.schemas import CASH_ACTUALS, CASH_PLAN, CASH_PLAN_INPUTS, DEFAULT_ENTITY, ENTITY, MONEY

_WEEK = T.StructType([T.StructField(name, MONEY) for name in CASH_PLAN_INPUTS])
_CLOSED = T.StructType([f for f in CASH_ACTUALS.fields if f.name != ENTITY])
DOCUMENT = T.StructType(
    [T.StructField(ENTITY, T.StringType()), T.StructField("saldo_inicial", MONEY)]
    + [T.StructField(f"S{week}", _WEEK) for week in range(1, C.CASH_WEEKS + 1)]
    + [T.StructField("historico", T.ArrayType(_CLOSED))]
)


_CORRUPT = "_corrupt_record"


def _documents(spark: SparkSession, paths: str | list[str], multi_line: bool) -> DataFrame:
    """One row per document of files with one document a line, or with one document or a list of them (``multi_line``).

    All fields are read whatever is asked for later, so a document is good or bad for every job alike.
    """
    texts = spark.read.text(paths, wholetext=multi_line).select(F.col("_metadata.file_path").alias("archivo"), "value")
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>"))
    single = texts.select("archivo", F.explode(F.coalesce(listed, F.array("value"))).alias("documento")).where(F.trim("documento") != "")
    schema = T.StructType([*DOCUMENT.fields, T.StructField(_CORRUPT, T.StringType())])
    return single.withColumn("d", F.from_json("documento", schema, {"columnNameOfCorruptRecord": _CORRUPT}))


def read_plan_documents(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Documents that can be read; the others are in `plan_document_rejects`. A document without a company is of the default one."""
    documents = _documents(spark, paths, multi_line).where(F.col(f"d.{_CORRUPT}").isNull()).select("d.*")
    return documents.select(F.coalesce(ENTITY, F.lit(DEFAULT_ENTITY)).alias(ENTITY), *DOCUMENT.fieldNames()[1:])


def plan_document_rejects(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Documents that are no JSON or hold something else where an amount, a date or a list belongs: file and text."""
    return _documents(spark, paths, multi_line).where(F.col(f"d.{_CORRUPT}").isNotNull()).select("archivo", "documento")


def plan_documents(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """The plan by week and the ledger as one document per company, the way back from `plan_weeks` and `closed_weeks`."""
    week = F.struct(*CASH_PLAN_INPUTS)
    plans = plan.groupBy(ENTITY).agg(
        F.max("saldo_inicial").alias("saldo_inicial"),
        *(F.max(F.when(F.col("week") == number, week)).alias(f"S{number}") for number in range(1, C.CASH_WEEKS + 1)))
    closed = F.struct(*(F.col(name).cast(_CLOSED[name].dataType).alias(name) for name in _CLOSED.fieldNames()))
    history = ledger.groupBy(ENTITY).agg(F.sort_array(F.collect_list(closed)).alias("historico"))  # a row per week of a company
    return plans.join(history, ENTITY, "full").select(*DOCUMENT.fieldNames())


def plan_weeks(documents: DataFrame) -> DataFrame:
    """Four rows per document; anything missing is 0."""
    zero = F.lit(0).cast(MONEY)
    weeks = F.array(*(
        F.struct(
            F.lit(week).alias("week"),
            *(F.coalesce(F.col(f"S{week}.{name}"), zero).alias(name) for name in CASH_PLAN_INPUTS),
        )
        for week in range(1, C.CASH_WEEKS + 1)
    ))
    return documents.select(ENTITY, F.coalesce("saldo_inicial", zero).alias("saldo_inicial"), F.explode(weeks).alias("w")).select(
        ENTITY, "w.week", "saldo_inicial", *(f"w.{name}" for name in CASH_PLAN_INPUTS)
    ).select(*CASH_PLAN.fieldNames())


def closed_weeks(documents: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """One row per closed week; documents without a history give none.

    Older documents have only the label of a week, ``DD/MM - DD/MM``, without a year: its Monday is the latest one
    with that day and month that is not after ``as_of``. Weeks that have neither are in `closed_week_rejects`.
    """
    return _closed(documents, as_of).where(F.col("week_start").isNotNull()).select(*CASH_ACTUALS.fieldNames())


def closed_week_rejects(documents: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """Closed weeks whose first day cannot be told."""
    return _closed(documents, as_of).where(F.col("week_start").isNull()).select(*CASH_ACTUALS.fieldNames())


def closed_week_guesses(documents: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """Closed weeks whose year is told from the label alone: the same day and month is a Monday again after 5, 6 or 11 years, so
    an older week would be taken for a later one."""
    return _closed(documents, as_of).where(F.col("__guessed") & F.col("week_start").isNotNull()).select(*CASH_ACTUALS.fieldNames())


def _closed(documents: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    today = day(as_of)
    first = F.regexp_extract(F.coalesce("semana", F.lit("")), "([0-9]{1,2}/[0-9]{1,2})", 1)

    def in_year(year: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("/", first, year.cast("string")), F.lit("d/M/y")).cast("date")

    candidates = F.array(*(in_year(F.year(today) - back) for back in range(0, 12)))
    fits = F.filter(candidates, lambda date: (date <= today) & (F.weekday(date) == 0))
    rows = documents.select(ENTITY, F.explode("historico").alias("h")).select(ENTITY, "h.*")
    return rows.withColumn("__guessed", F.col("week_start").isNull()).withColumn("week_start", F.coalesce("week_start", F.get(fits, F.lit(0))))


def empty_plan(entities: DataFrame) -> DataFrame:
    """The plan of companies that have not saved one: zeros in all four weeks."""
    zero = F.lit(0).cast(MONEY)
    return entities.select(ENTITY).distinct().select(
        ENTITY, F.explode(F.sequence(F.lit(1), F.lit(C.CASH_WEEKS))).alias("week"),
        zero.alias("saldo_inicial"), *(zero.alias(name) for name in CASH_PLAN_INPUTS),
    )


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASH_PLAN).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASH_ACTUALS).parquet(path).select(*CASH_ACTUALS.fieldNames())
