"""Supplier bills from many files with uneven headers; the paid bills come through the same reader."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo import constants as C
from arqueo.functions import text
from arqueo.schemas import DEFAULT_ENTITY, ENTITY
from arqueo.session import landed
from arqueo.sources import columns as col
from arqueo.sources.text_files import OPEN_QUOTE, headers, read_lines, unclosed, with_header


def normal_header(name: str) -> str:
    return name.strip().upper().replace(" ", "_")


def normalize_headers(df: DataFrame) -> DataFrame:
    """Upper-case, underscored, aliased column names; the first of equal names stays."""
    def keep_first(frame: DataFrame, names: list[str]) -> DataFrame:
        marked = frame.toDF(*(f"{i}__{name}" for i, name in enumerate(names)))
        firsts = {name: f"{i}__{name}" for i, name in reversed(list(enumerate(names)))}
        ordered = sorted(firsts.items(), key=lambda pair: int(pair[1].split("__")[0]))
        return marked.select(*(F.col(f"`{old}`").alias(name) for name, old in ordered))

    entity = {ENTITY.upper(): ENTITY}
    df = keep_first(df, [entity.get(n, n) for n in map(normal_header, df.columns)])
    return keep_first(df, [C.BILL_HEADER_ALIASES.get(name, name) for name in df.columns])


def _keep_named(rows: DataFrame) -> DataFrame:
    """Rows with a creation date text and a supplier; a blank supplier stays."""
    created = text.clean(F.col("GENERACIO").cast("string"))
    return rows.where(created.isNotNull() & (created != "") & F.col("PROVEEDOR").isNotNull())


def _usable(rows: DataFrame, *others: str) -> DataFrame:
    """The columns of a bill, and ``others``, of the rows with a value and both dates.

    Text is read behind a generator, so that the filter carries no second copy of how it is read.
    """
    read = (col.money(rows, "VALOR"), col.date(rows, "GENERACIO", day_first=True), col.date(rows, "VENCIMIENTO", day_first=True))
    if any(isinstance(rows.schema[name].dataType, T.StringType) for name in ("VALOR", "GENERACIO", "VENCIMIENTO")):
        values, read = (F.explode(F.array(F.struct(*read))).alias("__leido"),), ("__leido.VALOR", "__leido.GENERACIO", "__leido.VENCIMIENTO")
    else:
        values, read = read, ("VALOR", "GENERACIO", "VENCIMIENTO")
    bills = _keep_named(rows).select(
        col.entity(rows), col.label(rows, "PROVEEDOR"), F.col("FACTURA").cast("string").alias("FACTURA"), *values, *others)
    return bills.select(ENTITY, "PROVEEDOR", "FACTURA", *read, *others).na.drop(subset=["GENERACIO", "VENCIMIENTO", "VALOR"])


def _rejected(rows: DataFrame) -> DataFrame:
    """The rows that cannot be used with the reason, behind a generator too."""
    return rows.drop("motivo").select("*", F.explode(F.array(_reason(rows))).alias("motivo")).where(F.col("motivo").isNotNull())


def prepare_bills(raw: DataFrame) -> DataFrame:
    """Normalize headers, check them, coerce, and drop rows without usable dates or value."""
    df = normalize_headers(raw)
    col.require(df, C.BILL_COLUMNS, "compras")
    extras = [name for name in df.columns if name not in C.BILL_COLUMNS and name != ENTITY]
    return _usable(df, *extras)


def _reason(df: DataFrame) -> Column:
    """Why a row of bills cannot be used, NULL if it can."""
    created = text.clean(F.col("GENERACIO").cast("string"))
    return (
        F.when(created.isNull() | (created == ""), "sin GENERACIO").when(F.col("PROVEEDOR").isNull(), "sin PROVEEDOR")
        .when(col.date(df, "GENERACIO", day_first=True).isNull(), "GENERACIO ilegible")
        .when(col.date(df, "VENCIMIENTO", day_first=True).isNull(), "VENCIMIENTO ilegible")
        .when(col.money(df, "VALOR").isNull(), "VALOR ilegible")
    )


def bill_rejects(raw: DataFrame) -> DataFrame:
    """The rows that `prepare_bills` drops, as they came, with the reason in ``motivo``."""
    df = normalize_headers(raw)
    col.require(df, C.BILL_COLUMNS, "compras")
    return _rejected(df)


def union_bills(tables: list[DataFrame]) -> tuple[DataFrame | None, list[tuple[int, str]]]:
    """Union of the usable tables by column name, and (position, reason) of those passed over."""
    union, rejected = None, []
    for position, table in enumerate(tables):
        try:
            bills = prepare_bills(table)
        except col.MissingColumns as problem:
            rejected.append((position, str(problem)))
            continue
        union = bills if union is None else union.unionByName(bills, allowMissingColumns=True)
    return union, rejected


def _names(header: Column) -> Column:
    """Normalized, aliased names of a header array."""
    upper = F.transform(header, lambda name: F.replace(text.clean(F.upper(name)), F.lit(" "), F.lit("_")))

    def aliased(name: Column) -> Column:
        result = name
        for alias, target in C.BILL_HEADER_ALIASES.items():
            result = F.when(name == alias, F.lit(target)).otherwise(result)
        return result

    return F.transform(upper, aliased)


def _bill_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    names = _names(F.col("encabezado"))
    complete = F.size(F.array_intersect(names, F.array(*map(F.lit, C.BILL_COLUMNS)))) == len(C.BILL_COLUMNS)
    return with_header(read_lines(spark, paths)).withColumns({"nombres": names, "completo": complete})


def _bill_rows(spark: SparkSession, paths: str | list[str], entity: str) -> DataFrame:
    """The records of all files whose header has the required columns, cells as text."""
    lines = _bill_lines(spark, paths).where("completo")

    def field(name: str) -> Column:
        return F.get(F.col("campos"), (F.array_position("nombres", name) - 1).cast("int")).alias(name)

    known = F.array(*map(F.lit, (*C.BILL_COLUMNS, ENTITY.upper())))
    pairs = F.arrays_zip(F.col("nombres").alias("n"), F.slice(F.col("campos"), F.lit(1), F.size("nombres")).alias("v"))
    position = F.transform(F.col("nombres"), lambda name, i: F.array_position(F.col("nombres"), name) == i + 1)
    extras = F.map_from_entries(F.transform(
        F.filter(F.arrays_zip(pairs.alias("p"), position.alias("primera")), lambda e: e["primera"] & ~F.array_contains(known, e["p"]["n"])),
        lambda e: F.struct(e["p"]["n"], e["p"]["v"]),
    ))
    company = F.coalesce(field(ENTITY.upper()), F.lit(entity)).alias(ENTITY)
    return lines.select(company, *(field(name) for name in C.BILL_COLUMNS), extras.alias("extras"), "archivo", "bloque", "linea")


def read_bills(spark: SparkSession, paths: str | list[str], entity: str = DEFAULT_ENTITY) -> DataFrame:
    """Bills of all files whose header has the required columns; other columns go into the map ``extras``.

    The same column name twice in a file: the first one counts. What is not here is in `bill_line_rejects` (records) or
    `bill_file_rejects` (whole files).
    """
    return _usable(_bill_rows(spark, paths, entity), "extras", "archivo")


def bill_line_rejects(spark: SparkSession, paths: str | list[str], entity: str = DEFAULT_ENTITY) -> DataFrame:
    """The records that `read_bills` drops, cells as text, with the reason in ``motivo`` and their place in the file."""
    rows = _bill_rows(spark, paths, entity)
    return _rejected(rows)


def bill_file_rejects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files passed over, with the columns they lack (``faltan``) and the reason."""
    header = headers(read_lines(spark, paths))
    missing = F.array_except(F.array(*map(F.lit, C.BILL_COLUMNS)), _names(F.col("encabezado")))
    lacking = header.select("archivo", missing.alias("faltan"), F.lit("faltan columnas").alias("motivo")).where(F.size("faltan") > 0)
    return lacking.unionByName(unclosed(spark, paths).select(
        "archivo", F.array().cast("array<string>").alias("faltan"), F.lit(OPEN_QUOTE).alias("motivo")))


def with_extra_columns(bills: DataFrame) -> DataFrame:
    """``bills`` from `read_bills` with a column for each name in ``extras``, NULL where a file does not have it.

    A column of which every value reads as a number is DECIMAL(38,6), one of which every value reads as a day is DATE, others are
    text. One aggregate finds names and types; it has a row per column name, which is all that comes to the driver. The bills
    are landed for it, so that the files are not read and split a second time for the result.
    """
    bills = landed(bills)
    value = text.clean(F.col("valor"))
    given = bills.select(F.explode("extras").alias("nombre", "valor")).where(value != "")
    kinds = given.groupBy("nombre").agg(
        F.bool_and(value.try_cast("decimal(38,6)").isNotNull()).alias("numero"), F.bool_and(text.to_day(value, True).isNotNull()).alias("dia")).collect()
    columns = []
    for row in sorted(kinds):
        cell = text.clean(F.try_element_at("extras", F.lit(row["nombre"])))
        typed = cell.try_cast("decimal(38,6)") if row["numero"] else text.to_day(cell, True) if row["dia"] else cell
        columns.append(typed.alias(row["nombre"]))
    return bills.select(*(c for c in bills.columns if c != "extras"), *columns)
