"""Session set-up and the shared folder that iterative operators write to."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corvane", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under; on a cluster use the cluster's own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests, a laptop) a folder of our own is made and set; on a
    cluster, where no executor could read it, a missing setting is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    sc = spark.sparkContext
    own = sc.getCheckpointDir()
    if own is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-shared-"))
        own = sc.getCheckpointDir()
    return own.rstrip("/")


class Workspace:
    """Tables written to the shared folder to cut lineage; a lost executor re-reads them, it recomputes nothing.

    save() writes and reads back, drop() deletes a table that a later round has replaced. A result is lazy and may read
    the tables, so they stay until its reader is done with it: use the workspace as a context around the reading, call
    close(), or sweep() the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{label}-{self._n:03d}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvane_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_corvane_path", None)
        if path:
            _delete(self.spark, path)

    def close(self) -> None:
        _delete(self.spark, self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession, older_than: float) -> int:
    """Deletes workspaces in the shared folder that nothing was written to for so many seconds; how many there were."""
    root = f"{shared_dir(spark)}/corvane"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return 0
    old = [s.getPath().toString() for s in fs.listStatus(p) if s.getModificationTime() < (time.time() - older_than) * 1000]
    for path in old:
        _delete(spark, path)
    return len(old)


def rows_of(df: DataFrame) -> int:
    """Rows of a saved table; parquet footers answer it without reading columns."""
    return df.count()


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a table that comes in fewer splits than there are cores more partitions; else leave it as read.

    For tables as read from files only: their splits are known without running anything. Large tables have more splits
    than cores, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(per_core * cores)
