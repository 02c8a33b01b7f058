"""Age and risk class of a bill."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arqueo import constants as C


def credit_days(generated: Column, due: Column) -> Column:
    return F.datediff(due, generated)


def is_overdue(due: Column, as_of: Column) -> Column:
    return due < as_of


def days_overdue(due: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, due), F.lit(0))


def days_to_due(due: Column, as_of: Column) -> Column:
    return F.datediff(due, as_of)


def is_due_soon(due: Column, as_of: Column, soon_days: int = C.DUE_SOON_DAYS) -> Column:
    return days_to_due(due, as_of).between(1, soon_days)


def risk_class(
    due: Column, as_of: Column,
    critical_after: int = C.CRITICAL_AFTER_DAYS, soon_days: int = C.DUE_SOON_DAYS,
) -> Column:
    """Four classes that partition the bills; one due on the as-of day itself is still current."""
    return (
        F.when(days_overdue(due, as_of) > critical_after, C.RISK_CRITICAL)
        .when(is_overdue(due, as_of), C.RISK_RECENT)
        .when(is_due_soon(due, as_of, soon_days), C.RISK_SOON)
        .otherwise(C.RISK_CURRENT)
    )
