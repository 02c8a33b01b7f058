"""Delimited text files whose headers differ from file to file.

Spark's CSV reader takes one header for all files. Here each line keeps its file and its place
in it; the first line of every file is found by an aggregate (one row per file) and joined back.
Files may be split among tasks. A quoted field may hold commas and line breaks; a quote that does not
start a field, like an inch mark, is a character.

Whether a line starts a record depends on the quotes before it in its file. A line maps "starts outside a quoted field" and
"starts inside one" to how it ends, and such maps can be combined in any grouping: along the lines of one block of a file,
then along its blocks, of which there is one row each. So no file is put in order as a whole. Only files in which some
record goes over a line break need this at all, and only the lines of such records are brought together.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arqueo.functions.text import csv_fields, ends_quoted
from arqueo.session import landed

# The 33 low bits of the row id count rows inside a task's partition, in reading order.
_ROW_IN_PARTITION = (1 << 33) - 1
_PLACE = ("bloque", "linea")
OPEN_QUOTE = "comillas sin cerrar"


def _numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("archivo"),
        F.col("_metadata.file_block_start").alias("bloque"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION)).alias("linea"),
        "value",
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(archivo, bloque, linea, value): each non-blank record, ordered by (bloque, linea) inside a file.

    A file with a quoted field that never ends cannot be told apart into records; it has none here and is in `unclosed`.
    """
    lines = _numbered(spark, paths)
    broken = _files_with_breaks(lines)
    plain = lines.join(broken, "archivo", "left_anti")
    return plain.unionByName(_records(lines.join(broken, "archivo", "left_semi"))).where(F.trim("value") != "")


def plain_path(path: Column) -> Column:
    """A path of a file as people write it: without the scheme of local files and without escapes."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def unclosed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files with a quoted field that never ends: ``archivo``, the number of its lines, and the place (block, line) of the record that does not end."""
    lines = _numbered(spark, paths)
    lines = lines.join(_files_with_breaks(lines), "archivo", "left_semi")
    return _begun(lines).where("__sin_cerrar").groupBy("archivo").agg(
        F.count(F.lit(1)).alias("lineas"), F.max(F.when(F.col("__empieza"), F.struct(*_PLACE))).alias("desde"))


def _files_with_breaks(lines: DataFrame) -> DataFrame:
    """Without a line that ends inside a quoted field, every line of a file is a record. Landed: a row per file that is asked for several times."""
    return landed(lines.where(ends_quoted(F.col("value"))).select("archivo").distinct())


def _after(start: Column, fixed: Column, flips: Column) -> Column:
    """State after some lines: the last line whose end does not depend on its start gives it, the lines that turn it over since then change it."""
    parity = F.when(fixed.isNotNull(), flips - fixed["flips"]).otherwise(flips) % 2 == 1
    return F.coalesce(fixed["ends"], start) != parity


def _begun(lines: DataFrame) -> DataFrame:
    """``lines`` with whether each starts a record (``__empieza``), whether a quoted field is open after it (``__abierta``), and
    whether one is at the end of its file (``__sin_cerrar``)."""
    block = W.partitionBy("archivo", "bloque").orderBy("linea")
    before, upto = block.rowsBetween(W.unboundedPreceding, -1), block.rowsBetween(W.unboundedPreceding, 0)
    outside, inside = F.col("__outside"), F.col("__inside")
    marked = (
        lines.withColumns({"__outside": ends_quoted(F.col("value")), "__inside": ends_quoted(F.col("value"), True)})
        .withColumn("__flips", F.sum((outside & ~inside).cast("long")).over(upto))
        .withColumn("__fixed", F.when(outside == inside, F.struct(outside.alias("ends"), F.col("__flips").alias("flips"))))
        .withColumns({"__fixed_before": F.last("__fixed", True).over(before), "__flips_before": F.coalesce(F.lag("__flips").over(block), F.lit(0))})
    )
    line = F.struct("linea")
    blocks = marked.groupBy("archivo", "bloque").agg(
        F.max_by("__fixed", F.when(F.col("__fixed").isNotNull(), line)).alias("fixed"), F.max("__flips").alias("flips"))
    # The same again over the blocks of a file, one row each.
    file = W.partitionBy("archivo").orderBy("bloque")
    total = F.sum("flips").over(file.rowsBetween(W.unboundedPreceding, 0))
    moved = F.when(F.col("fixed").isNotNull(), F.struct(F.col("fixed.ends").alias("ends"), (total - F.col("flips") + F.col("fixed.flips")).alias("flips")))
    earlier = file.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns({"total": total, "moved": moved}).withColumns({
        "__f": F.last("moved", True).over(earlier), "__n": F.coalesce(F.lag("total").over(file), F.lit(0))})
    whole = file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = blocks.withColumn("__inicio", _after(F.lit(False), F.col("__f"), F.col("__n"))).select(
        "archivo", "bloque", "__inicio", F.last(_after(F.col("__inicio"), F.col("fixed"), F.col("flips"))).over(whole).alias("__sin_cerrar"))
    known = marked.join(starts, ["archivo", "bloque"]).withColumn(
        "__empieza", ~_after(F.col("__inicio"), F.col("__fixed_before"), F.col("__flips_before")))
    open_after = F.when(F.col("__empieza"), outside).otherwise(inside)
    return known.select("archivo", *_PLACE, "value", "__empieza", open_after.alias("__abierta"), "__sin_cerrar")


def _records(lines: DataFrame) -> DataFrame:
    """Records of files in which some go over several lines."""
    begun = landed(_begun(lines).where(~F.col("__sin_cerrar")))
    place = F.struct(*_PLACE)
    single = begun.where(F.col("__empieza") & ~F.col("__abierta")).select("archivo", *_PLACE, "value")
    several = begun.where(~F.col("__empieza") | F.col("__abierta"))
    # The line with which a record starts: the last one in the block that does, or else the last one in an earlier block.
    starts = F.when(F.col("__empieza"), place)
    block = W.partitionBy("archivo", "bloque").orderBy("linea").rowsBetween(W.unboundedPreceding, 0)
    carried = several.groupBy("archivo", "bloque").agg(F.max(starts).alias("ultima")).select(
        "archivo", "bloque", F.last("ultima", True).over(W.partitionBy("archivo").orderBy("bloque").rowsBetween(W.unboundedPreceding, -1)).alias("__antes"))
    placed = several.join(carried, ["archivo", "bloque"]).withColumn("__de", F.coalesce(F.last(starts, True).over(block), F.col("__antes")))
    joined = placed.groupBy("archivo", "__de").agg(F.array_sort(F.collect_list(F.struct(*_PLACE, "value"))).alias("partes")).select(
        "archivo", "__de.*", F.array_join(F.col("partes.value"), "\n").alias("value"))
    return single.unionByName(joined)


def headers(lines: DataFrame) -> DataFrame:
    """One row per file: its header fields and the place of the header. Only the line that wins is split."""
    place = F.struct(*_PLACE)
    first = lines.groupBy("archivo").agg(F.min_by("value", place).alias("value"), F.min(place).alias("__primera"))
    return first.select("archivo", "__primera", csv_fields(F.col("value")).alias("encabezado"))


def with_header(lines: DataFrame) -> DataFrame:
    """Data lines, split into ``campos``, with the header fields of their file in ``encabezado``.

    The lines are landed, as they are looked at twice, for the headers and for the rest.
    """
    lines = landed(lines)
    joined = lines.join(headers(lines), "archivo").where(F.struct(*_PLACE) != F.col("__primera"))
    return joined.withColumn("campos", csv_fields(F.col("value"))).drop("__primera", "value")
