"""Journal operators: folds with two merge modes, chain checks, heads, diffs, segments, ordered appends."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import Workspace

#: Event types whose edges are inserted only if their id was never seen; all others overwrite.
INSERT_MODE = ("atom_committed", "memories_distilled", "memory_transaction_committed", "atom_merged")


def fold(rows: DataFrame, key: str) -> DataFrame:
    """The state after rows (key, graph_version, pos, insert_only, deleted, ...) are applied in order.

    An insert-only row counts only as the first sighting of its key, even if the key was deleted since; of the
    rest the last wins, and if that deletes, the key is absent. Two aggregations, no key is gathered.
    """
    at = F.struct("graph_version", "pos")
    first = F.min(at).alias("first")
    last = F.max(F.when(~F.col("insert_only"), at)).alias("last")
    t = rows.groupBy(key).agg(first, last)
    win = t.select(key, F.greatest("last", F.col("first")).alias("at"))
    return rows.join(win, key).where(at == F.col("at")).where(~F.col("deleted")).drop("at", "insert_only", "deleted", "pos").dropDuplicates([key])


def fold_states(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Last-wins state of rows (key, deleted, ...)."""
    rest = [c for c in rows.columns if c != key]
    s = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
    return s.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def chain_problems(journal: DataFrame, order: str = "graph_version") -> DataFrame:
    """(graph_version, problem): gaps in the version sequence, broken links to the previous event's checksum.

    Each event is joined to its predecessor by version, so no total order runs through one task.
    """
    e = journal.where(F.col(order).isNotNull()).select(order, "previous_event_hash", "checksum").dropDuplicates([order])
    prev = e.select((F.col(order) + 1).alias(order), F.col("checksum").alias("expected"), F.lit(True).alias("has_prev"))
    j = e.join(prev, order, "left")
    problem = F.when((F.col(order) != 1) & F.col("has_prev").isNull(), "gap").when(F.col("has_prev") & ~F.col("previous_event_hash").eqNullSafe(F.col("expected")), "broken_link")
    return j.select(order, problem.alias("problem")).where("problem is not null")


def version_gaps(journal: DataFrame, blocks: int = 1 << 20) -> DataFrame:
    """(from_version, to_version): missing runs, found block by block and across block borders."""
    v = journal.where("graph_version is not null").select("graph_version").distinct().withColumn("b", F.floor(F.col("graph_version") / blocks))
    inside = v.withColumn("prev", F.lag("graph_version").over(W.partitionBy("b").orderBy("graph_version"))).select("graph_version", "prev").where("prev is not null")
    ends = v.groupBy("b").agg(F.min("graph_version").alias("lo"), F.max("graph_version").alias("hi"))
    across = ends.select(F.col("lo").alias("graph_version"), F.lag("hi").over(W.orderBy("b")).alias("prev")).where("prev is not null")
    return inside.unionByName(across).where("graph_version > prev + 1").select((F.col("prev") + 1).alias("from_version"), (F.col("graph_version") - 1).alias("to_version"))


def diff(stored: DataFrame, replayed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problem): missing from the stored state, unexpected in it, or different."""
    s, r = stored.select(key, F.col(value).alias("s"), F.lit(True).alias("in_s")), replayed.select(key, F.col(value).alias("r"), F.lit(True).alias("in_r"))
    j = s.join(r, key, "full_outer")
    return j.select(key, F.when(F.col("in_s").isNull(), "missing").when(F.col("in_r").isNull(), "unexpected").when(~F.col("s").eqNullSafe(F.col("r")), "different").alias("problem")).where("problem is not null")


def idempotency(journal: DataFrame) -> DataFrame:
    """(actor, idempotency_key, first_event, uses, conflicts): keys used more than once, and uses with another payload."""
    k = journal.where("idempotency_key is not null").select("actor", "idempotency_key", "event_id", "graph_version", "payload_digest").distinct()
    first = k.groupBy("actor", "idempotency_key").agg(F.min_by(F.struct("event_id", "payload_digest"), F.struct("graph_version", "event_id")).alias("f"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    other = k.join(first, ["actor", "idempotency_key"]).groupBy("actor", "idempotency_key").agg(F.min("f.event_id").alias("first_event"), F.min("uses").alias("uses"), F.count_if(F.col("payload_digest") != F.col("f.payload_digest")).alias("conflicts"))
    return other


def heads(journal: DataFrame) -> DataFrame:
    """(actor, event_type, head_version, head_ref): each series' newest event and how many came before it."""
    e = journal.select("actor", "event_type", "graph_version", "event_id").distinct()
    return e.groupBy("actor", "event_type").agg(F.count(F.lit(1)).alias("head_version"), F.max_by("event_id", F.struct("graph_version", "event_id")).alias("head_ref"))


def head_history(journal: DataFrame) -> DataFrame:
    """(actor, event_type, version, ref, valid_from, valid_to): every head of a series and the time it stood."""
    w = W.partitionBy("actor", "event_type").orderBy("graph_version", "event_id")
    e = journal.select("actor", "event_type", "graph_version", "event_id", "accepted_at").dropDuplicates(["event_id"])
    return e.select("actor", "event_type", F.row_number().over(w).alias("version"), F.col("event_id").alias("ref"), F.col("accepted_at").alias("valid_from"), F.lead("accepted_at").over(w).alias("valid_to"))


def cas_conflicts(commands: DataFrame, state: DataFrame) -> DataFrame:
    """(command_id, outcome): of commands (command_id, target, expected, position) one per target is accepted, the
    first whose expected version is the target's; the others conflict. Commands without an expectation are accepted."""
    j = commands.join(state.select(F.col("key").alias("target"), "version"), "target", "left").withColumn("fits", F.col("expected").isNull() | (F.col("expected") == F.coalesce("version", F.lit(0))))
    first = j.where("fits and expected is not null").groupBy("target").agg(F.min(F.struct("position", "command_id")).alias("f")).select("target", F.col("f.command_id").alias("winner"))
    out = j.join(first, "target", "left")
    return out.select("command_id", F.when(F.col("expected").isNull(), "accepted").when(F.col("fits") & (F.col("winner") == F.col("command_id")), "accepted").otherwise("conflict").alias("outcome"))


def segments(journal: DataFrame, size: int, keep_tail: int) -> DataFrame:
    """(segment, from_version, to_version, events, digest): full segments below the tail, with a digest of their events.

    The digest is a sum of per-event hashes, so it does not depend on order or partitioning.
    """
    e = journal.dropDuplicates(["event_id"]).where("graph_version is not null")
    upto = e.agg(F.max("graph_version") - keep_tail).scalar()
    s = e.where(F.col("graph_version") <= upto).withColumn("segment", F.floor((F.col("graph_version") - 1) / size))
    return s.groupBy("segment").agg(F.min("graph_version").alias("from_version"), F.max("graph_version").alias("to_version"), F.count(F.lit(1)).alias("events"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "event_id", "payload_digest", "graph_version"), 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def append(new: DataFrame, last_version: int, last_hash: str, most: int = 5_000_000) -> DataFrame:
    """new (event_id, position, payload_digest) chained to the journal: (event_id, graph_version, previous_event_hash, checksum).

    Versions come from ranges of the order, all in parallel. The chain hashes every event with the one before, which
    is sequential by definition: it runs over digests alone, one batch of a single ordered writer of at most `most`
    events; a larger one is refused, it must be appended in parts.
    """
    ws = Workspace(new.sparkSession, "append")
    e = ws.save(new.repartitionByRange("position", "event_id").select("event_id", "position", "payload_digest", F.spark_partition_id().alias("pid")), "events")
    if e.count() > most:
        raise ValueError(f"a batch holds at most {most} events")
    per = e.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("pid", (F.sum("n").over(W.orderBy("pid")) - F.col("n")).alias("before"))
    rn = F.row_number().over(W.partitionBy("pid").orderBy("position", "event_id"))
    v = e.withColumn("rn", rn).join(before, "pid").select("event_id", (F.col("rn") + F.col("before") + last_version).alias("graph_version"), "payload_digest")

    def chain(batches):
        prev = last_hash
        for b in batches:
            ids, versions, digests = (b.column(c).to_pylist() for c in ("event_id", "graph_version", "payload_digest"))
            prevs, sums = [], []
            for i, g, d in zip(ids, versions, digests):
                prevs.append(prev)
                prev = hashlib.sha256(f"{prev}|{g}|{i}|{d}".encode()).hexdigest()
                sums.append(prev)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("graph_version"), pa.array(prevs, pa.string()), pa.array(sums, pa.string())], names=["event_id", "graph_version", "previous_event_hash", "checksum"])

    return v.repartition(1).sortWithinPartitions("graph_version").mapInArrow(chain, "event_id string, graph_version bigint, previous_event_hash string, checksum string")
