"""Line items and ratios out of free-form statements."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.functions import finance
from arqueo.functions.text import last_number
from arqueo.schemas import ENTITY

ITEMS = tuple(C.STATEMENT_KEYWORDS)
BLOCK = ("file_seq", "sheet_seq", "block_seq")
RATIOS = (
    "Razón Corriente", "Prueba Ácida", "Capital de Trabajo", "Nivel Endeudamiento", "Cobertura Intereses",
    "Margen Bruto", "Margen Operativo", "Margen Neto", "ROA", "ROE",
)


def _row_text(cells: Column) -> Column:
    """All cells of a row, upper case, joined by one space; empty cells are skipped."""
    def shown(cell: Column) -> Column:
        number = F.when(~F.isnan(cell["num"]), cell["num"].cast("string"))
        return F.upper(F.coalesce(cell["raw"], number))

    return F.array_join(F.transform(cells, shown), " ")


def _row_number(cells: Column) -> Column:
    """The number of the rightmost cell that holds one."""
    def value(cell: Column) -> Column:
        return F.coalesce(F.when(~F.isnan(cell["num"]), cell["num"]), last_number(cell["raw"]))

    numbers = F.filter(F.transform(F.reverse(cells), value), lambda number: number.isNotNull())
    return F.get(numbers, F.lit(0))


def _mentions(text: Column, keywords: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(keywords[0]))
    for keyword in keywords[1:]:
        found = found | F.contains(text, F.lit(keyword))
    return found


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with one more column that is worked out once per row. Filters on a plain column are moved below it and carry
    a copy of its expression along; what `explode` gives out stays where it is."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def statement_items(rows: DataFrame) -> DataFrame:
    """Fifteen line items per entity: size of the first non-zero number, in file, sheet and row
    order, on a row that mentions the item; 0 when no row does.

    The text of a row is looked through once, for all keywords; rows without any mention are dropped before their
    number is looked for, also once. What is left is one row per item, and the row that wins is an aggregate (`min_by` over
    the row position), so an entity's rows need neither be sorted nor brought together: first within each
    block of a sheet, where the position is one number and the buffers have a fixed size, then over the blocks.
    """
    mentions = F.array(*(F.when(_mentions(F.col("__text"), words), F.lit(i)) for i, words in enumerate(C.STATEMENT_KEYWORDS.values())))
    mentioned = _once(_once(rows, "__text", _row_text(F.col("cells"))), "__items", F.array_compact(mentions)).where(F.size("__items") > 0)
    numbered = _once(mentioned.select(ENTITY, *BLOCK, "row_seq", "cells", "__items"), "__number", F.abs(_row_number(F.col("cells"))))
    found = numbered.where(F.col("__number") != 0).select(ENTITY, *BLOCK, "row_seq", "__number", F.explode("__items").alias("__item"))
    blocks = found.groupBy(ENTITY, *BLOCK, "__item").agg(F.min_by("__number", "row_seq").alias("__number"))
    items = blocks.groupBy(ENTITY, "__item").agg(F.min_by("__number", F.struct(*BLOCK)).alias("__number"))
    # Every entity has a row, those without any mention with zeros in all items.
    everyone = rows.select(ENTITY).distinct().select(ENTITY, F.lit(None).cast("int").alias("__item"), F.lit(None).cast("double").alias("__number"))
    return items.unionByName(everyone).groupBy(ENTITY).agg(*(
        F.coalesce(F.max(F.when(F.col("__item") == i, F.col("__number"))), F.lit(0.0)).alias(item) for i, item in enumerate(ITEMS)))


def statement_items_long(items: DataFrame) -> DataFrame:
    return items.unpivot([ENTITY], list(ITEMS), "concepto", "valor")


def statement_ratios(items: DataFrame) -> DataFrame:
    ratios = finance.ratio_columns({name: F.col(name) for name in ITEMS})
    return items.select(ENTITY, *(value.alias(name) for name, value in ratios.items()))


def working_capital_days(items: DataFrame, payables: DataFrame, ratios: bool = False) -> DataFrame:
    """DSO, DIO, DPO and the cash cycle per entity; the ratios as well if asked for, from the same pass over ``items``.
    ``payables`` has entity_id and total_cxp."""
    cost = F.col("Costo de Venta")
    owed = F.coalesce(F.col("total_cxp").cast("double"), F.lit(0.0))
    more = finance.ratio_columns({name: F.col(name) for name in ITEMS}) if ratios else {}
    days = items.join(payables.select(ENTITY, "total_cxp"), ENTITY, "left").select(
        ENTITY, *(value.alias(name) for name, value in more.items()),
        finance.turnover_days(F.col("Cuentas por Cobrar"), F.col("Ingresos")).alias("dso"),
        finance.turnover_days(F.col("Inventarios"), cost).alias("dio"),
        finance.turnover_days(owed, cost).alias("dpo"),
    )
    return days.withColumn("ccc", finance.cash_cycle(F.col("dio"), F.col("dso"), F.col("dpo")))
