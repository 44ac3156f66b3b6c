"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run a rendering over the given tables without touching the session's views."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})
