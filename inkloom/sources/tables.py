"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of this name; columns are pruned by what is made of it. The
    workers get this package, in case a query runs any of it there."""
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
