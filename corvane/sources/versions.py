"""Versioned table folders and JSON-lines ingestion.

A table is a folder with one sub-folder a version and one marker file for each version that counts. A writer stages a
new version and then creates its marker, so readers see whole versions only; a publisher that worked from an older
version than the current one is refused, and nothing is ever deleted or replaced to publish.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StaleVersion(RuntimeError):
    """Somebody else published since the version this write was based on."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, root: str) -> int:
    """The published version, 0 if there is none."""
    fs, p = _fs(spark, f"{root}/_versions")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=0)


def commit(spark: SparkSession, root: str, version: int, folder: str) -> None:
    """Makes the version count by creating its marker, which names the folder of its rows; there is no other step.

    Of two writers of one version one creates the marker and the other gets StaleVersion. Markers are never changed.
    """
    fs, at = _fs(spark, f"{root}/_versions/v{version:08d}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise StaleVersion(f"{root} has a version {version} already") from e
    out.write(bytearray(folder.encode()))
    out.close()


def publish(df: DataFrame, root: str, based_on: int, compression: str = "zstd") -> int:
    """Writes df as the version after based_on and makes it current; raises StaleVersion if that is not current."""
    spark = df.sparkSession
    if current_version(spark, root) != based_on:
        raise StaleVersion(f"{root} is no longer at version {based_on}")
    new = based_on + 1
    folder = f"v{new:08d}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", compression).parquet(f"{root}/{folder}")
    commit(spark, root, new, folder)
    return new


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A pinned version, by default the current one; it never changes under the reader."""
    version = version or current_version(spark, root)
    folder = spark.read.text(f"{root}/_versions/v{version:08d}").first()[0]
    return spark.read.parquet(f"{root}/{folder}")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): records of a JSON-lines source by schema; lines that do not parse come back as text."""
    base = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*base.fields, T.StructField("_line", T.StringType())])
    df = spark.read.text(path).select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_line"}).alias("r"), "value").where(F.trim("value") != "")
    bad = F.col("r").isNull() | F.col("r._line").isNotNull()
    return df.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in base.fields]), df.where(bad).select(F.col("value").alias("line"))


def json_argument(value: str) -> object:
    """A JSON argument given inline or as @file."""
    if value.startswith("@"):
        with open(value[1:], encoding="utf-8") as f:
            return json.load(f)
    return json.loads(value)
