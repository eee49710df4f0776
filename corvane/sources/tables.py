"""Readers of the store's tables.

Time columns are read as UTC timestamps whatever the file says (with or without zone), so that every
operator compares instants of one type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def tables(spark: SparkSession, folder: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, folder, n) for n in names)
