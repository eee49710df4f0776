"""Scans, lookups and filters over the store's tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.scopes import scope_map, scope_visible

#: Lifecycle states in the order a scan prefers them, all others behind; health states held back.
HOT_ORDER = ("active", "proposed")
LOW_HEALTH = ("confounding", "low_utility", "merged", "orphaned", "stale")


def hot_rank(c: str = "lifecycle_state") -> Column:
    rank = F.lit(len(HOT_ORDER))
    for i, state in reversed(list(enumerate(HOT_ORDER))):
        rank = F.when(F.col(c) == state, F.lit(i)).otherwise(rank)
    return rank


def payload_matches(fields: dict[str, Iterable[str]], payload: str = "payload") -> Column:
    """Top-level payload fields, as text, are one of the given values; an empty list of values matches nothing."""
    ok = F.lit(True)
    for name, values in fields.items():
        values = list(dict.fromkeys(values))
        if len(values) > 2048 or len(fields) > 16 or any(x in name for x in '."[]'):
            raise ValueError("at most 16 top-level fields with at most 2048 values each")
        ok = ok & (F.get_json_object(payload, f"$.{name}").isin(*values) if values else F.lit(False))
    return F.coalesce(ok, F.lit(False))


def filtered(atoms: DataFrame, *, include_deleted: bool = False, types: Iterable[str] = (), lifecycle: Iterable[str] = (), without_health: Iterable[str] = (), payload: dict[str, Iterable[str]] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """A record scan by type, lifecycle, health, payload fields and an id list (a table, joined as a semi join)."""
    ok = F.lit(True) if include_deleted else ~F.coalesce(F.col("deleted"), F.lit(False))
    if types:
        ok = ok & F.col("type").isin(*types)
    if lifecycle:
        ok = ok & F.col("lifecycle_state").isin(*lifecycle)
    if without_health:
        ok = ok & ~F.coalesce(F.col("health_status").isin(*without_health), F.lit(False))
    if payload:
        ok = ok & payload_matches(payload)
    out = atoms.where(ok)
    return out.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi") if ids is not None else out


def newest(atoms: DataFrame, limit: int, hot_first: bool = True) -> DataFrame:
    """The first `limit` records, hot states first, then newest; ties by id."""
    order = ([hot_rank().asc()] if hot_first else []) + [F.col("updated_at").desc_nulls_last(), F.col("id").asc()]
    return atoms.orderBy(*order).limit(limit)


def resolve(refs: DataFrame, atoms: DataFrame, evidence: DataFrame) -> DataFrame:
    """(ref, kind): atom, evidence, ambiguous if both bear the id, else unknown. A deleted atom still resolves."""
    known = atoms.select(F.col("id").alias("ref"), F.lit("atom").alias("k")).unionByName(evidence.select(F.col("evidence_id").alias("ref"), F.lit("evidence").alias("k")))
    kinds = known.where(F.col("ref").isNotNull()).groupBy("ref").agg(F.min("k").alias("a"), F.max("k").alias("z"))
    kind = F.when(F.col("a").isNull(), "unknown").when(F.col("a") != F.col("z"), "ambiguous").otherwise(F.col("a"))
    return refs.select("ref").where(F.col("ref").isNotNull()).distinct().join(kinds, "ref", "left").select("ref", kind.alias("kind"))


def visibility_reasons(atoms: DataFrame, asked: dict[str, str], lifecycle: Iterable[str] = ("active",), include_conflicts: bool = False, include_low_health: bool = False) -> DataFrame:
    """(id, reason): why a reader does not get a record, the first reason that applies; null reason: visible."""
    reason = F.when(F.coalesce(F.col("deleted"), F.lit(False)), "deleted").when(~F.coalesce(F.col("lifecycle_state").isin(*lifecycle), F.lit(False)), "lifecycle")
    reason = reason.when(~scope_visible(scope_map(), asked), "scope")
    if not include_conflicts:
        reason = reason.when(F.col("health_status") == "contradicted", "contradicted")
    if not include_low_health:
        reason = reason.when(F.col("health_status").isin(*LOW_HEALTH), "low_health")
    return atoms.select("id", reason.alias("reason"))


def edges_of(edges: DataFrame, refs: DataFrame, relations: Iterable[str] = ()) -> DataFrame:
    """Live edges with an end among refs(ref); each edge once."""
    e = edges.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    if relations:
        e = e.where(F.col("relation").isin(*relations))
    r = refs.select("ref").distinct()
    near = e.join(r.withColumnRenamed("ref", "source_ref"), "source_ref", "left_semi").unionByName(e.join(r.withColumnRenamed("ref", "target_ref"), "target_ref", "left_semi"))
    return near.dropDuplicates(["edge_id"])


def edges_page(edges: DataFrame, refs: DataFrame, relations: Iterable[str], limit: int) -> DataFrame:
    """edges_of() in order of edge_id, `limit` of them, each with truncated: whether there were more."""
    got = edges_of(edges, refs, relations).orderBy("edge_id").limit(limit + 1)
    numbered = got.withColumn("__n", F.row_number().over(W.orderBy("edge_id")))
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return numbered.withColumn("truncated", F.max("__n").over(all_) > limit).where(F.col("__n") <= limit).drop("__n")


def with_retired(edges: DataFrame, retired: DataFrame) -> DataFrame:
    """Edges, and for retired ids that are no edge any more a deleted edge without ends."""
    gone = retired.select("edge_id").where("edge_id is not null").distinct().join(edges.select("edge_id"), "edge_id", "left_anti")
    blank = [F.lit(True).alias(c) if c == "deleted" else F.col("edge_id") if c == "edge_id" else F.lit(None).cast(t).alias(c) for c, t in edges.dtypes]
    return edges.unionByName(gone.select(*blank))


def at_version(rows: DataFrame, version: int | None = None) -> DataFrame:
    """The rows built at one graph_version, by default the newest."""
    version = rows.agg(F.max("graph_version")).first()[0] if version is None else version
    return rows.where(F.col("graph_version") == F.lit(version))


def newest_events(journal: DataFrame, event_type: str, limit: int) -> DataFrame:
    """(event_id, graph_version): the newest events of a type, repeated rows once."""
    return journal.where(F.col("event_type") == event_type).select("event_id", "graph_version").distinct().orderBy(F.desc("graph_version"), "event_id").limit(limit)


def tail(journal: DataFrame, after: int, limit: int) -> DataFrame:
    """Journal entries after a version, in order, repeated rows once."""
    return journal.where(F.col("graph_version") > after).dropDuplicates(["event_id"]).orderBy("graph_version", "event_id").limit(limit)


def page(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """A cursor page: `limit` rows after the cursor and, on each, whether more follow (one row more is fetched)."""
    got = rows.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    numbered = got.withColumn("__n", F.row_number().over(W.orderBy(key)))
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return numbered.withColumn("has_more", F.max("__n").over(all_) > limit).where(F.col("__n") <= limit).drop("__n")


def supersession(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """(ref, superseded_by): records that an active record replaces, with all that replace them, sorted."""
    live = ~F.coalesce(F.col("deleted"), F.lit(False))
    a = atoms.where(live).select("id", "lifecycle_state").dropDuplicates(["id"])
    e = edges.where(live & (F.col("lifecycle_state") == "active") & (F.col("relation") == "rel:supersedes")).select("source_ref", "target_ref").distinct()
    new = a.where("lifecycle_state = 'active'").select(F.col("id").alias("source_ref"))
    old = a.where("lifecycle_state in ('active', 'superseded')").select(F.col("id").alias("target_ref"))
    return e.join(new, "source_ref", "left_semi").join(old, "target_ref", "left_semi").groupBy(F.col("target_ref").alias("ref")).agg(F.array_join(F.array_sort(F.collect_set("source_ref")), ",").alias("superseded_by"))


def isolated(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of live records that are an end of no live edge."""
    ends = edges.where(~F.coalesce(F.col("deleted"), F.lit(False))).select(F.explode(F.array("source_ref", "target_ref")).alias("id")).where("id is not null").distinct()
    return atoms.where(~F.coalesce(F.col("deleted"), F.lit(False))).select("id").distinct().join(ends, "id", "left_anti")
