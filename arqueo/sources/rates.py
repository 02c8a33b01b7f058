"""Published rate intervals, landed as JSON lines or arrays under one folder per source."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.schemas import TRM_INTERVALOS
from arqueo.sources import columns as col

_LANDED = T.StructType([T.StructField(n, T.StringType()) for n in ("valor", "vigenciadesde", "vigenciahasta")])


def prepare_intervals(raw: DataFrame, priority: int = 1) -> DataFrame:
    rank = F.col("prioridad") if "prioridad" in raw.columns else F.lit(priority)
    return raw.select(
        rank.cast("int").alias("prioridad"), F.col("valor").cast("string").alias("valor"),
        col.date(raw, "vigenciadesde"), col.date(raw, "vigenciahasta"),
    )


def read_rate_intervals(spark: SparkSession, folders: list[str], multi_line: bool = True) -> DataFrame:
    """Folders in order of preference: the first one with usable rates is taken by `daily_rates`."""
    table = spark.createDataFrame([], TRM_INTERVALOS)
    for priority, folder in enumerate(folders, start=1):
        landed = spark.read.schema(_LANDED).option("multiLine", multi_line).json(folder)
        table = table.unionByName(prepare_intervals(landed, priority))
    return table
