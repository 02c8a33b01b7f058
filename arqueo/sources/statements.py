"""Statement rows: from delimited text, or from tables with typed cells."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.schemas import DEFAULT_ENTITY, ENTITY
from arqueo.sources.text_files import OPEN_QUOTE, plain_path, read_lines, unclosed, with_header

_CELL = "struct<raw:string,num:double>"


def read_statement_files(spark: SparkSession, paths: str | list[str], entity: str = DEFAULT_ENTITY, manifest: DataFrame | None = None) -> DataFrame:
    """Rows below each file's header. Lines with more fields than the header are dropped, shorter ones kept.

    ``manifest`` has a row per file: ``archivo`` (its path), ``entity_id`` and ``orden`` (a whole number, the place in the order of upload), so one
    read serves many companies and later files come later whatever they are called. A file that is not in it is left out; see
    `statement_file_rejects`. Without a manifest all files are of ``entity``, in the order of their paths.
    """
    rows = _statement_lines(spark, paths, entity, manifest).where(F.size("campos") <= F.size("encabezado"))
    cells = F.transform("campos", lambda field: F.struct(field.alias("raw"), F.lit(None).cast("double").alias("num")))
    return rows.select(
        ENTITY, "file_seq", F.lit(1).alias("sheet_seq"),
        F.col("bloque").alias("block_seq"), F.col("linea").alias("row_seq"), cells.cast(f"array<{_CELL}>").alias("cells"),
    )


def _statement_lines(spark: SparkSession, paths: str | list[str], entity: str, manifest: DataFrame | None) -> DataFrame:
    lines = with_header(read_lines(spark, paths))
    if manifest is None:
        return lines.withColumns({ENTITY: F.lit(entity), "file_seq": F.col("archivo")})
    listed = _listed(manifest).select("ruta", ENTITY, "file_seq")
    return lines.withColumn("ruta", plain_path(F.col("archivo"))).join(listed, "ruta").drop("ruta")


def _listed(manifest: DataFrame) -> DataFrame:
    """One row per path; a path listed twice counts where it comes first. ``file_seq`` sorts like the order of upload."""
    path = plain_path(F.col("archivo"))
    first = manifest.groupBy(path.alias("ruta")).agg(F.min(F.struct("orden", ENTITY)).alias("f"))
    place = F.lpad(F.col("f.orden").cast("string"), 19, "0")
    return first.select("ruta", F.col(f"f.{ENTITY}").alias(ENTITY), F.concat_ws(" ", place, "ruta").alias("file_seq"))


def statement_line_rejects(spark: SparkSession, paths: str | list[str], entity: str = DEFAULT_ENTITY, manifest: DataFrame | None = None) -> DataFrame:
    """Lines passed over because they have more fields than the header of their file."""
    rows = _statement_lines(spark, paths, entity, manifest).where(F.size("campos") > F.size("encabezado"))
    return rows.select(ENTITY, "archivo", "bloque", "linea", "campos", F.lit("más campos que el encabezado").alias("motivo"))


def statement_file_rejects(spark: SparkSession, paths: str | list[str], manifest: DataFrame | None = None) -> DataFrame:
    """``archivo`` and ``motivo`` of files that cannot be read, are not in the manifest, or are in it and not there."""
    open_files = unclosed(spark, paths).select(plain_path(F.col("archivo")).alias("archivo"), F.lit(OPEN_QUOTE).alias("motivo"))
    if manifest is None:
        return open_files
    # Of files that Spark reads as empty there is no line to tell their path; they count as missing.
    found = spark.read.text(paths).select(plain_path(F.col("_metadata.file_path")).alias("archivo")).distinct()
    listed = _listed(manifest).select(F.col("ruta").alias("archivo"))
    return (
        open_files.unionByName(found.join(listed, "archivo", "left_anti").withColumn("motivo", F.lit("no está en la lista")))
        .unionByName(listed.join(found, "archivo", "left_anti").withColumn("motivo", F.lit("no hay archivo")))
    )


def cells_from_columns(df: DataFrame, columns: list[str]) -> F.Column:
    """Cells of a landed sheet: numeric columns count as numbers, the others as text."""
    numeric = (T.NumericType,)
    return F.array(*(
        F.struct(
            F.lit(None).cast("string").alias("raw") if isinstance(df.schema[name].dataType, numeric) else F.col(name).cast("string").alias("raw"),
            F.col(name).cast("double").alias("num") if isinstance(df.schema[name].dataType, numeric) else F.lit(None).cast("double").alias("num"),
        )
        for name in columns
    ))
