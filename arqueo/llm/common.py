"""Shared helpers: the folder for intermediate tables, the white space of the contracts."""

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.session import shared_folder

#: ASCII white space and its complement, as both Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def landed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage is cut, and a lost executor loses nothing.
    Tables that nobody discards are removed by the folder's owner once the application has ended."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.landed_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes landed tables that nothing will read any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.landed_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now rather than at its next garbage collection."""
    for _ in range(2):  # what the first frees lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
