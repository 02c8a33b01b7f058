"""Session settings for tests and benchmarks; a cluster brings its own session."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cores: int | str = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may go without the setting; it then gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="arqueo-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def read_again(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def landed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back, so that a job that takes them more than once works them out once."""
    path = new_table_path(rows.sparkSession)
    rows.write.parquet(path)
    return read_again(rows.sparkSession, path, rows)
