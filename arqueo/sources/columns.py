"""Column contracts: required columns, company column, typed coercion."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.functions import text
from arqueo.schemas import DEFAULT_ENTITY, ENTITY, MONEY, RATE


class MissingColumns(ValueError):
    """A table lacks columns the calculation needs."""


def require(df: DataFrame, columns: Iterable[str], table: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"{table}: missing columns {missing}")


def entity(df: DataFrame) -> Column:
    return F.col(ENTITY).cast("string") if ENTITY in df.columns else F.lit(DEFAULT_ENTITY).alias(ENTITY)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def label(df: DataFrame, name: str, upper: bool = False) -> Column:
    column = F.col(name).cast("string")
    return (text.clean_upper(column) if upper else text.clean(column)).alias(name)


def money(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return (text.to_money(column) if _is_text(df, name) else column.try_cast(MONEY)).alias(name)


def rate(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return (text.to_rate(column) if _is_text(df, name) else column.try_cast(RATE)).alias(name)


def date(df: DataFrame, name: str, day_first: bool = False) -> Column:
    column = F.col(name)
    return (text.to_day(column, day_first) if _is_text(df, name) else column.cast("date")).alias(name)
