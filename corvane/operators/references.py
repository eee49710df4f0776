"""Problem 4: references to records that do not exist, that were removed, or that arrive later.

References are cut down to distinct (space, ref, period) before anything moves, so a ref that holds a third of
all rows is a handful of rows. Those and the parents' keys are partitioned by key and sorted; each task walks
its keys in ranges of up to 2**16 distinct keys, numbers them (the dictionary), and holds one compressed bitmap
of referred keys per period and one of the parents that exist before that period began. Referred AND NOT present
leaves the surviving bits: keys that are missing, removed, or created in or after the period. Only these are
decoded and joined back to the referring rows, where the exact times decide between `late` and nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.bitmaps import CHUNK, Bitmap

REF, LIVE, GONE = 0, 1, 2


def edge_references(edges: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, space, ref, created_at) of every reference that live edges make."""
    e = edges.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    item = lambda field, space, ref: F.struct(F.lit(field).alias("field_name"), F.lit(space).alias("space"), ref.alias("ref"))
    refs = F.concat(
        F.array(item("source_ref", 0, F.col("source_ref")), item("target_ref", 0, F.col("target_ref"))),
        F.coalesce(F.transform("evidence_refs", lambda r: item("evidence_refs", 1, r)), F.array().cast("array<struct<field_name:string,space:int,ref:string>>")),
    )
    return e.select(F.lit("edges").alias("table_name"), F.col("edge_id").alias("row_id"), "created_at", F.explode(refs).alias("r")).select("table_name", "row_id", "r.field_name", "r.space", "r.ref", "created_at").where("ref is not null and ref <> ''")


def atom_references(atoms: DataFrame) -> DataFrame:
    a = atoms.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    return a.select(F.lit("atoms").alias("table_name"), F.col("id").alias("row_id"), F.lit("evidence_refs").alias("field_name"), F.lit(1).alias("space"), F.explode("evidence_refs").alias("ref"), "created_at").where("ref is not null and ref <> ''")


def parent_keys(atoms: DataFrame, seed_atoms: DataFrame, interactions: DataFrame, evidence: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(space, ref, role, at): what exists and what is known to be gone, per space of ids (0 records, 1 evidence)."""
    k = lambda df, space, ref, role, at: df.select(F.lit(space).alias("space"), F.col(ref).alias("ref"), role.alias("role"), at.alias("at")).where("ref is not null")
    none = F.lit(None).cast("timestamp")
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    t = tombstones.select("target_ref")
    return (
        k(atoms, 0, "id", F.when(gone, GONE).otherwise(LIVE), F.col("created_at"))
        .unionByName(k(seed_atoms, 0, "id", F.lit(LIVE), F.col("created_at")))
        .unionByName(k(interactions, 0, "id", F.lit(LIVE), F.col("created_at")))
        .unionByName(k(evidence, 1, "evidence_id", F.lit(LIVE), F.col("captured_at")))
        .unionByName(k(t, 0, "target_ref", F.lit(GONE), none))
        .unionByName(k(t, 1, "target_ref", F.lit(GONE), none))
    )


_OUT = pa.schema([("space", pa.int32()), ("ref", pa.string()), ("period", pa.int32()), ("status", pa.int32()), ("since", pa.timestamp("us", tz="UTC"))])
_NEVER = np.iinfo(np.int64).max


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks rows sorted by (space, ref); a range has at most CHUNK distinct keys, and once CHUNK rows are held all keys but
    the last, which may go on, are worked off."""
    held: list[tuple] = []
    rows = 0

    def month(us: int) -> int:
        d = datetime.utcfromtimestamp(us / 1e6) if us >= 0 else datetime(1970, 1, 1)
        return d.year * 12 + d.month - 1

    def work(spaces, refs, roles, periods, at) -> pa.RecordBatch | None:
        new = np.empty(len(refs), dtype=bool)
        new[0] = True
        new[1:] = (refs[1:] != refs[:-1]) | (spaces[1:] != spaces[:-1])
        code = np.cumsum(new) - 1
        keys, space = refs[new], spaces[new]
        n = len(keys)
        live, gone = roles == LIVE, roles == GONE
        since = np.full(n, _NEVER)
        np.minimum.at(since, code[live], at[live])
        exists = np.zeros(n, dtype=bool)
        exists[code[live]] = True
        removed = np.zeros(n, dtype=bool)
        removed[code[gone]] = True
        refers = roles == REF
        asked = np.unique(periods[refers])
        if not len(asked):
            return None
        born = np.full(n, _NEVER)
        known = exists & (since != np.iinfo(np.int64).min)
        months = {u: month(int(u)) for u in np.unique(since[known] // 86_400_000_000 * 86_400_000_000)} if known.any() else {}
        if months:
            days = since[known] // 86_400_000_000 * 86_400_000_000
            u, inv = np.unique(days, return_inverse=True)
            born[known] = np.array([months[x] for x in u], dtype=np.int64)[inv]
        born[exists & ~known] = -1  # no time: there from the start
        present, upto, got = Bitmap.of(np.empty(0, dtype=np.int64)), -2, []
        for p in asked:
            # a referring row without a time (period -1) can only miss what never exists
            edge = _NEVER - 1 if p < 0 else int(p) - 1
            if p < 0:
                there = Bitmap.of(np.flatnonzero(exists))
            else:
                present = present | Bitmap.of(np.flatnonzero((born > upto) & (born <= edge)))
                upto, there = edge, present
            left = Bitmap.of(code[refers & (periods == p)]).and_not(there).decode()
            if len(left):
                got.append((left, np.full(len(left), p)))
        if not got:
            return None
        left = np.concatenate([g[0] for g in got])
        period = np.concatenate([g[1] for g in got])
        status = np.where(exists[left], 2, np.where(removed[left], 1, 0))
        when = since[left]
        return pa.RecordBatch.from_arrays([pa.array(space[left], pa.int32()), pa.array(keys[left], pa.string()), pa.array(period, pa.int32()), pa.array(status, pa.int32()), pa.array(when, pa.timestamp("us", tz="UTC"), mask=~exists[left] | (when == np.iinfo(np.int64).min))], schema=_OUT)

    def flush(upto: int | None) -> pa.RecordBatch | None:
        cols = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        if upto is not None and upto < len(cols[0]):
            held.append(tuple(c[upto:] for c in cols))
            cols = [c[:upto] for c in cols]
        return work(*cols) if len(cols[0]) else None

    for b in batches:
        if not b.num_rows:
            continue
        at = b.column("at").cast(pa.int64())
        role = b.column("role").to_numpy()
        us = at.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        held.append((b.column("space").to_numpy(), b.column("ref").to_numpy(zero_copy_only=False), role, b.column("period").to_numpy(), us))
        rows += b.num_rows
        if rows < CHUNK:  # fewer rows than keys a range may have
            continue
        refs = np.concatenate([h[1] for h in held])
        spaces = np.concatenate([h[0] for h in held])
        change = np.flatnonzero((refs[1:] != refs[:-1]) | (spaces[1:] != spaces[:-1])) + 1
        ends = [*change[CHUNK - 1 :: CHUNK].tolist()]  # a range of CHUNK keys each
        if len(change):
            ends.append(int(change[-1]))  # the last key may go on in the next batch
        done = 0
        for end in dict.fromkeys(ends):
            out = flush(end - done)
            done = end
            if out is not None:
                yield out
        rows = sum(len(h[1]) for h in held)
    if held:
        out = flush(None)
        if out is not None:
            yield out


def orphan_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(space, ref, period, status, since) of the keys a period refers to that did not all exist before it.

    period: months since year 0, -1 for referring rows without a time. status: 0 missing, 1 removed, 2 exists
    since `since` (in that period or later, so rows must be compared one by one; null: from the start).
    """
    period = F.coalesce((F.year("created_at") * 12 + F.month("created_at") - 1), F.lit(-1)).cast("int")
    asked = refs.select("space", "ref", F.lit(REF).alias("role"), period.alias("period"), F.lit(None).cast("timestamp").alias("at")).groupBy("space", "ref", "role", "period").agg(F.min("at").alias("at"))
    # a parent counts as present from its earliest row on, and from the start if any of its rows has no time
    at = F.when(F.count("at") < F.count(F.lit(1)), F.lit(None)).otherwise(F.min("at"))
    have = parents.groupBy("space", "ref", "role").agg(at.alias("at")).select("space", "ref", "role", F.lit(-1).alias("period"), "at")
    both = asked.unionByName(have)
    return both.repartition("space", "ref").sortWithinPartitions("space", "ref").mapInArrow(_survivors, "space int, ref string, period int, status int, since timestamp")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, missing_ref, reason, period), distinct, one row per reference nothing answers.

    reason: `missing`, `deleted` (a removed record or a tombstone bears the id) or `late` (the target exists but
    its time is after the referring row's). period: yyyy-MM of the referring row, `unknown` without a time; such
    rows are never late, nor is a target without a time. Empty tables give no rows; a repeated reference in one
    field of one row counts once; a row without id is reported with a null row_id.
    """
    keys = orphan_keys(refs, parents)
    period = F.coalesce((F.year("created_at") * 12 + F.month("created_at") - 1), F.lit(-1)).cast("int")
    hit = refs.withColumn("period", period).join(keys, ["space", "ref", "period"])
    reason = F.when(F.col("status") == 0, "missing").when(F.col("status") == 1, "deleted").when(F.col("since") > F.col("created_at"), "late")
    return (
        hit.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("table_name", "row_id", "field_name", F.col("ref").alias("missing_ref"), "reason", F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown")).alias("period"))
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and reason."""
    return found.groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("references"), F.countDistinct("missing_ref").alias("refs"))
