"""The journal in three forms: a live tail, whole segments, and receipts of what was dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import Workspace


@dataclass
class Archive:
    """live and segments hold whole events, segments and receipts a segment number; a receipt has no payload."""

    live: DataFrame
    segments: DataFrame
    receipts: DataFrame
    catalogue: DataFrame


def _event_digest() -> Column:
    """A number by which events are added up: independent of order and partitioning."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", "event_id", "payload_digest", "graph_version", F.sha2(F.coalesce("payload", F.lit("")), 256)), 256), 1, 12), 16, 10).cast("decimal(38,0)")


def compact(journal: DataFrame, size: int, keep_tail: int, keep_segments: int) -> Archive:
    """Splits a journal: its last `keep_tail` versions stay live, older ones go to segments of `size` versions, of which
    the last `keep_segments` are kept whole and the rest as receipts, each with a digest of itself.

    Rows that repeat an event count once, the one ingested first; events without a version are left out.
    """
    ws = Workspace(journal.sparkSession, "archive")
    rest = [c for c in ("graph_version", "ingested_at", "event_type", "actor", "payload_digest", "previous_event_hash", "checksum", "payload") if c in journal.columns]
    e = journal.where("graph_version is not null and event_id is not null").groupBy("event_id").agg(F.min(F.struct(*rest)).alias("r")).select("event_id", *[F.col(f"r.{c}").alias(c) for c in rest])
    e = ws.save(e, "events")
    upto = (e.agg(F.max("graph_version")).first()[0] or 0) - keep_tail
    old = e.where(F.col("graph_version") <= upto).withColumn("segment", F.floor((F.col("graph_version") - 1) / size).cast("bigint"))
    last = old.agg(F.max("segment")).first()[0]
    last = -1 if last is None else last
    whole, gone = old.where(F.col("segment") > last - keep_segments), old.where(F.col("segment") <= last - keep_segments)
    catalogue = old.groupBy("segment").agg(F.min("graph_version").alias("from_version"), F.max("graph_version").alias("to_version"), F.count(F.lit(1)).alias("events"), F.sum(_event_digest()).alias("digest"))
    receipts = gone.drop("payload").withColumn("receipt_digest", F.sha2(F.concat_ws("|", "event_id", "graph_version", "payload_digest", "segment"), 256))
    return Archive(e.where(F.col("graph_version") > upto), ws.save(whole, "segments"), ws.save(receipts, "receipts"), ws.save(catalogue, "catalogue"))


def last_events(a: Archive, n: int) -> DataFrame:
    """The n newest events, wherever they are kept."""
    cols = ["event_id", "graph_version", "event_type", "actor", "payload_digest"]
    every = a.live.select(*cols).unionByName(a.segments.select(*cols)).unionByName(a.receipts.select(*cols))
    return every.orderBy(F.desc("graph_version"), F.desc("event_id")).limit(n)


def find(a: Archive, refs: DataFrame) -> DataFrame:
    """(event_id, found_in, graph_version, payload_digest): live first, then a segment, then a receipt; missing ones are left out."""
    cols = ["event_id", "graph_version", "payload_digest"]
    part = lambda df, name, rank: df.select(*cols, F.lit(name).alias("found_in"), F.lit(rank).alias("rank"))
    every = part(a.live, "live", 0).unionByName(part(a.segments, "segment", 1)).unionByName(part(a.receipts, "receipt", 2))
    got = every.join(refs.where("event_id is not null").select("event_id").distinct(), "event_id", "left_semi")
    return got.groupBy("event_id").agg(F.min(F.struct("rank", "found_in", "graph_version", "payload_digest")).alias("r")).select("event_id", "r.found_in", "r.graph_version", "r.payload_digest")


def check(a: Archive) -> DataFrame:
    """(segment, events, intact): whether the events of each whole segment still add up to the digest in the catalogue."""
    now = a.segments.groupBy("segment").agg(F.count(F.lit(1)).alias("events"), F.sum(_event_digest()).alias("d"))
    return now.join(a.catalogue.select("segment", "digest", F.col("events").alias("n")), "segment", "left").select("segment", "events", (F.coalesce(F.col("d") == F.col("digest"), F.lit(False)) & F.coalesce(F.col("n") == F.col("events"), F.lit(False))).alias("intact"))


def verified_receipts(a: Archive) -> DataFrame:
    """The receipts that still have the digest they were written with."""
    return a.receipts.where(F.col("receipt_digest") == F.sha2(F.concat_ws("|", "event_id", "graph_version", "payload_digest", "segment"), 256))


def status(a: Archive) -> DataFrame:
    """(storage, events, payload_bytes): how many events are live, compacted and kept as digests only, and their bytes."""
    size = F.octet_length(F.coalesce("payload", F.lit("")))
    part = lambda df, name, n: df.agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("payload_bytes")).select(F.lit(name).alias("storage"), "events", "payload_bytes")
    return part(a.live, "live", size).unionByName(part(a.segments, "compacted", size)).unionByName(part(a.receipts, "digest_only", F.lit(0))).where("events > 0")
