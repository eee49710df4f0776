"""The journal as a stream: incremental folds, idempotent intake, windowed counts, count-or-time triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.changes import ChangeFeed
from corvane.sources.versions import commit, current_version


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder as a stream; zone-less times become UTC timestamps, as watermarks need them."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    df = r.parquet(path)
    ntz = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def drop_repeats(stream: DataFrame, keys: list[str], event_time: str, within: str) -> DataFrame:
    """Rows whose keys came before within the given time are dropped; state is freed behind the watermark."""
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, window: str, slide: str | None, late: str, *keys: str) -> DataFrame:
    """Counts per event-time window and keys; rows later than `late` do not count."""
    w = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return stream.withWatermark(event_time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *keys, "n")


def fold_feed(stream: DataFrame, root: str, checkpoint: str):
    """Folds a journal that arrives by batches, rows repeated and late, into the state of a ChangeFeed in root.

    A batch that is run again after a failure counts once.
    """
    feed = ChangeFeed(stream.sparkSession, root)
    return stream.writeStream.foreachBatch(lambda batch, epoch: feed.apply(batch, epoch + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], rows: int, seconds: float, clock: Callable[[], float], checkpoint: str) -> None:
    """Calls work(all rows since its last call, number of the call) once at least `rows` rows or `seconds` have
    gathered, and a last time for what is left when the stream has no more.

    Rows wait in a folder beside the checkpoint, and a marker for each call says up to which batch it has been handed
    rows, so a restart goes on where it stopped. A call that failed is made again with the same number.
    """
    spark, root = stream.sparkSession, f"{checkpoint.rstrip('/')}-waiting"
    since = {"at": clock()}

    def waiting(upto: int) -> tuple[int, list[str]]:
        calls = current_version(spark, root)
        first = int(spark.read.text(f"{root}/_versions/v{calls:08d}").first()[0]) if calls else 0
        return calls, [f"{root}/b{n:08d}" for n in range(first, upto)]

    def hand_on(upto: int, always: bool) -> None:
        calls, paths = waiting(upto)
        if not paths:
            return
        held = spark.read.schema(stream.schema).parquet(*paths)
        n = held.count()
        if n and (always or n >= rows or clock() - since["at"] >= seconds):
            work(held, calls + 1)
            commit(spark, root, calls + 1, str(upto))
            since["at"] = clock()

    def tick(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/b{epoch:08d}")
        since["upto"] = epoch + 1
        hand_on(epoch + 1, False)

    q = stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    hand_on(since.get("upto", (last.batchId + 1) if last else 0), True)
