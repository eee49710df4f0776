"""Commands to journal events: idempotency, expected versions and tombstones decide, all over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compile_commands(commands: DataFrame, ledger: DataFrame, state: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of one batch of commands.

    commands: (command_id, position, actor, idempotency_key, kind, target, expected, payload_digest); kind is
    create, change or remove. ledger: (actor, idempotency_key, payload_digest) of earlier commands. state:
    (key, version). tombstones: (target_ref, recreation_policy, created_at), the newest per target counts.
    events: (command_id, position, kind, target, version). rejects: (command_id, reason), the first reason of
    repeated, idempotency_conflict, unknown_target, blocked, exists, version_conflict. Of the commands of a batch
    that would change one target the first by position wins, the others are version conflicts.
    """
    c = commands.dropDuplicates(["command_id"])
    used = ledger.where("idempotency_key is not null").groupBy("actor", "idempotency_key").agg(F.min("payload_digest").alias("old_digest"))
    c = c.join(used, ["actor", "idempotency_key"], "left")
    first = c.where("idempotency_key is not null").groupBy("actor", "idempotency_key").agg(F.min_by(F.struct("command_id", "payload_digest"), F.struct("position", "command_id")).alias("first"))
    c = c.join(first, ["actor", "idempotency_key"], "left")
    have = state.select(F.col("key").alias("target"), F.col("version").alias("now")).dropDuplicates(["target"])
    block = tombstones.groupBy(F.col("target_ref").alias("target")).agg(F.max_by("recreation_policy", F.coalesce("created_at", F.timestamp_micros(F.lit(0)))).alias("policy"))
    c = c.join(have, "target", "left").join(block, "target", "left")
    again = F.col("first.command_id") != F.col("command_id")
    known = F.coalesce(F.col("old_digest"), F.when(again, F.col("first.payload_digest")))
    reason = (
        F.when(known.isNotNull() & (known == F.col("payload_digest")), "repeated")
        .when(known.isNotNull(), "idempotency_conflict")
        .when((F.col("kind") != "create") & F.col("now").isNull(), "unknown_target")
        .when((F.col("kind") == "create") & F.col("now").isNull() & F.col("policy").isNotNull() & (F.col("policy") != "allow_recreate"), "blocked")
        .when((F.col("kind") == "create") & F.col("now").isNotNull(), "exists")
        .when(F.col("expected").isNotNull() & (F.col("expected") != F.coalesce("now", F.lit(0))), "version_conflict")
    )
    judged = c.withColumn("reason", reason)
    winner = judged.where("reason is null").groupBy("target").agg(F.min(F.struct("position", "command_id")).alias("w")).select("target", F.col("w.command_id").alias("winner"))
    judged = judged.join(winner, "target", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("winner") != F.col("command_id")), "version_conflict").otherwise(F.col("reason")))
    events = judged.where("reason is null").select("command_id", "position", "kind", "target", F.when(F.col("kind") == "remove", F.lit(None)).otherwise(F.coalesce("now", F.lit(0)) + 1).cast("bigint").alias("version"))
    return events, judged.where("reason is not null").select("command_id", "reason")


def payload_diff(before: DataFrame, after: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """(key, path, change): top-level payload fields added, removed or changed between two states of records."""
    flat = lambda df, name: df.select(key, F.explode(F.from_json(payload, "map<string,string>")).alias("path", name))
    a, b = flat(before, "old").withColumn("in_a", F.lit(True)), flat(after, "new").withColumn("in_b", F.lit(True))
    j = a.join(b, [key, "path"], "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select(key, "path", change.alias("change")).where("change is not null")


def feedback(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, utility, salience) after retrieval outcomes (ref, label): used adds 0.03 and 0.02, a corrected or negative
    use takes 0.06 of utility, both held between 0 and 1. All outcomes of a record are summed first."""
    good = F.count_if(F.col("label") == "used")
    bad = F.count_if(F.col("label").isin("corrected", "negative"))
    o = outcomes.groupBy(F.col("ref").alias("id")).agg(good.alias("good"), bad.alias("bad"))
    held = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return records.join(o, "id").select("id", held(F.coalesce("utility", F.lit(0.5)) + 0.03 * F.col("good") - 0.06 * F.col("bad")).alias("utility"), held(F.coalesce("salience", F.lit(0.5)) + 0.02 * F.col("good")).alias("salience"))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence by id, the row captured first; evidence is never overwritten."""
    rest = [c for c in evidence.columns if c not in ("evidence_id", "captured_at", "checksum")]
    order = F.struct(F.coalesce("captured_at", F.timestamp_micros(F.lit(0))).alias("at"), "checksum", "captured_at", *rest)
    return evidence.where("evidence_id is not null").groupBy("evidence_id").agg(F.min(order).alias("r")).select("evidence_id", "r.checksum", "r.captured_at", *[f"r.{c}" for c in rest])
