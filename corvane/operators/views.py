"""Derived views over records and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.records import parsed
from corvane.operators.quality import live


def latest_state(atoms: DataFrame) -> DataFrame:
    """(agent, id, updated_at): of each agent the newest live runtime state, ties by id."""
    a = live(atoms).where("type = 'runtime_state'").select("id", F.coalesce(F.get_json_object(parsed(), "$.agent_id"), F.get_json_object(parsed(), "$.subject_agent")).alias("agent"), "updated_at").where("agent is not null").distinct()
    return a.groupBy("agent").agg(F.min(F.struct(F.coalesce(-F.unix_micros("updated_at"), F.lit(2**63 - 1)).alias("t"), "id", "updated_at")).alias("m")).select("agent", "m.id", "m.updated_at")


def self_awareness(atoms: DataFrame, types: list[str]) -> DataFrame:
    """(agent, type, n, newest): what an agent knows about itself, by record type."""
    a = live(atoms).where(F.col("type").isin(*types)).dropDuplicates(["id"]).select("type", "updated_at", F.coalesce(F.get_json_object(parsed(), "$.agent_id"), F.get_json_object(parsed(), "$.subject_agent")).alias("agent")).where("agent is not null")
    return a.groupBy("agent", "type").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("newest"))


def open_items(atoms: DataFrame, edges: DataFrame, kind: str = "commitment") -> DataFrame:
    """Ids of live active records of a kind that no live closing edge points to."""
    done = live(edges).where("relation in ('rel:closes', 'rel:produced_outcome') and target_ref is not null").select(F.col("target_ref").alias("id")).distinct()
    return live(atoms).where((F.col("type") == kind) & (F.col("lifecycle_state") == "active")).select("id").distinct().join(done, "id", "left_anti")


def later_counterevidence(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n): live records that younger records contradict."""
    a = live(atoms).dropDuplicates(["id"]).select("id", "updated_at")
    e = live(edges).where("relation = 'rel:contradicts'").select("source_ref", "target_ref").distinct()
    j = e.join(a.select(F.col("id").alias("source_ref"), F.col("updated_at").alias("later")), "source_ref").join(a.select(F.col("id").alias("target_ref"), F.col("updated_at").alias("own")), "target_ref")
    return j.where("later > own").groupBy(F.col("target_ref").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def shared_items(views: DataFrame, parties: int) -> DataFrame:
    """views (party, ref, evidence array): refs all parties hold, with the evidence all of them have, sorted."""
    held = views.groupBy("ref").agg(F.count_distinct("party").alias("n")).where(F.col("n") == parties).select("ref")
    each = views.join(held, "ref", "left_semi").select("ref", "party", F.explode_outer("evidence").alias("e")).distinct()
    common = each.where("e is not null").groupBy("ref", "e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == parties)
    lists = common.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_list("e")), ",").alias("common_evidence"))
    return held.join(lists, "ref", "left").select("ref", F.coalesce("common_evidence", F.lit("")).alias("common_evidence"))


def projection(messages: DataFrame) -> DataFrame:
    """(conversation_id, sequence, id, actor, role, in_reply_to): message rows flattened, repeated ids once."""
    g = lambda f: F.get_json_object(parsed(), f"$.{f}")
    cid, seq = F.coalesce("conversation_id", g("conversation_id")), F.coalesce("sequence", g("sequence").try_cast("bigint"))
    m = messages.where("id is not null").select(cid.alias("conversation_id"), seq.alias("sequence"), "id", g("actor_ref").alias("actor"), F.lower(F.trim(g("role"))).alias("role"), g("in_reply_to").alias("in_reply_to"))
    return m.distinct()


def stream_position(messages: DataFrame, before: int = 3) -> DataFrame:
    """Adds preceding: ids of the up to `before` messages ahead of each in its conversation, oldest first."""
    w = W.partitionBy("conversation_id").orderBy("sequence", "id")
    prev = F.array_compact(F.array(*[F.lag("id", i).over(w) for i in range(before, 0, -1)]))
    return messages.withColumn("preceding", F.array_join(prev, ","))


def sessions(events: DataFrame, who: str, ts: str, gap_s: int) -> DataFrame:
    """(who, session, started, ended, n): runs of events with no gap above gap_s seconds."""
    w = W.partitionBy(who).orderBy(ts, "event_id")
    new = F.when(F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w) > gap_s * 1_000_000, 1).otherwise(0)
    e = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy(who, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the newest right value at or before its time, per key: one union, one window."""
    w = W.partitionBy(key).orderBy(ts, "side").rowsBetween(W.unboundedPreceding, 0)
    l_ = left.select(key, ts, "event_id", F.lit(1).alias("side"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value))
    r_ = right.select(key, ts, F.lit(None).cast("bigint").alias("event_id"), F.lit(0).alias("side"), value)
    return l_.unionByName(r_).withColumn("as_of", F.last(value, ignorenulls=True).over(w)).where("side = 1").select(key, ts, "event_id", "as_of")


def pages(messages: DataFrame, after: int, limit: int) -> DataFrame:
    """(conversation_id, sequence, id, has_more): of each conversation the `limit` messages after a sequence number."""
    m = messages.where(F.col("conversation_id").isNotNull() & (F.col("sequence") > after)).select("conversation_id", "sequence", "id").distinct()
    w = W.partitionBy("conversation_id").orderBy("sequence", "id")
    got = m.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit + 1)  # one more than asked: are there more?
    got = got.withColumn("has_more", F.max("n").over(W.partitionBy("conversation_id")) > limit)
    return got.where(F.col("n") <= limit).select("conversation_id", "sequence", "id", "has_more")
