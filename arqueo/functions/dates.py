"""Calendar expressions. The as-of day is always a parameter, never the clock."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: dt.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def month_start(as_of: Column) -> Column:
    return F.trunc(as_of, "MM").cast("date")


def previous_month_end(as_of: Column) -> Column:
    return F.date_sub(month_start(as_of), 1)


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def monday(as_of: Column) -> Column:
    return F.date_trunc("week", as_of).cast("date")


def week_start(as_of: Column, week: Column) -> Column:
    """Monday of the given week, counted from 1 at the week of ``as_of``."""
    return F.date_add(monday(as_of), ((week - 1) * 7).cast("int"))


def week_end(as_of: Column, week: Column) -> Column:
    return F.date_add(week_start(as_of, week), 6)


def span_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "dd/MM"), F.lit(" - "), F.date_format(end, "dd/MM"))


def week_label(as_of: Column, week: Column) -> Column:
    span = span_label(week_start(as_of, week), week_end(as_of, week))
    return F.concat(F.lit("Sem "), week.cast("string"), F.lit(" ("), span, F.lit(")"))


def due_week(as_of: Column, due: Column, weeks: int) -> Column:
    """Week 1 takes everything due up to its Sunday; days past the last week give NULL."""
    ahead = F.floor(F.datediff(due, monday(as_of)) / 7).cast("int") + 1
    return F.when(ahead <= 1, 1).when(ahead <= weeks, ahead)
