"""Named intermediate tables under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint(tables: dict[str, DataFrame], directory: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}")


def restore(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}")


def read_reference(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Boundary and population reference tables, downloaded beforehand."""
    return restore(spark, directory, name)
