"""Loan and asset tables."""

from pyspark.sql import DataFrame, SparkSession

from arqueo.schemas import LOAN_ASSETS, LOANS


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOANS).parquet(path)


def read_loan_assets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOAN_ASSETS).parquet(path)
