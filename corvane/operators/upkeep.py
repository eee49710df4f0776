"""What upkeep decides about records: duplicates, cohorts, decay, windows, capacity, differences and link candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.records import parsed
from corvane.functions.text import first_filled
from corvane.functions.times import seconds_since
from corvane.operators import derive, graph, quality, scans, views
from corvane.operators.quality import live
from corvane.session import Workspace

#: How bad a state of health is, for what is given up first; outcomes that say nothing has happened yet;
#: types that age alone never archives.
HEALTH_RANK = {"low_utility": 0, "orphaned": 0, "stale": 0, "confounding": 1, "contradicted": 1, "healthy": 2}
OPEN_OUTCOMES = ("issued", "pending", "planned", "started")
PROTECTED_TYPES = ("adjudication", "commitment", "covenant", "policy", "primal_guidance", "self_model")
DAY = 86_400


def field(name: str) -> Column:
    """A top-level or dotted field of a payload that parses, as text."""
    return F.get_json_object(parsed(), f"$.{name}")


def _said(c: Column) -> Column:
    """A value that is neither missing nor empty, of any JSON type."""
    return c.isNotNull() & ~c.isin("", "[]", "{}", "null")


def proposed_duplicates(atoms: DataFrame, lifecycle: str = "proposed") -> DataFrame:
    """(id, kept): proposed records of one type, scope and stated key; the one with most evidence stays, then the oldest."""
    a = live(atoms).where(F.col("lifecycle_state") == lifecycle).dropDuplicates(["id"])
    a = a.select("id", "type", F.coalesce("scope", F.lit("")).alias("sc"), field("retention.deduplication_key").alias("k"), F.struct((-F.greatest(F.coalesce(F.size("evidence_refs"), F.lit(0)), F.lit(0))).alias("n"), F.col("created_at").alias("at"), F.col("id").alias("i")).alias("order")).where("k is not null and k <> ''")
    best = a.groupBy("type", "sc", "k").agg(F.min("order").alias("b"))
    return a.join(best, ["type", "sc", "k"]).where("id <> b.i").select("id", F.col("b.i").alias("kept"))


def distillation_candidates(atoms: DataFrame, types: list[str]) -> DataFrame:
    """(id, cohort, priority, at): active, sound records worth condensing, with the cohort they may be condensed in (type and scope). Records that a condensed one already names are left out."""
    a = live(atoms).where("lifecycle_state = 'active'").dropDuplicates(["id"])
    covered = a.where("type = 'semantic'").select(F.explode(F.from_json(field("source_refs"), "array<string>")).alias("id")).distinct()
    outcome = F.lower(first_filled(field("outcome"), field("status"), field("result")))
    score = F.when(F.lower(F.coalesce(first_filled(field("maintenance_hints.kind"), field("kind")), F.lit(""))).isin("reflection", "outcome", "evaluation"), 6).otherwise(0)
    score = score + F.when(field("maintenance_hints.distill") == "true", 4).otherwise(0) + F.when(outcome.isNotNull() & ~outcome.isin(*OPEN_OUTCOMES), 4).otherwise(0)
    for name in ("directive_atom_ref", "source_directive_ref", "metric_deltas", "deltas", "lesson", "correction"):
        score = score + F.when(_said(field(name)), 2).otherwise(0)
    score = score + F.when(first_filled(field("summary"), field("claim")).isNotNull(), 1).otherwise(0) + F.when(_said(field("applied_controls")) | _said(field("requested_controls")), 1).otherwise(0)
    c = a.where(F.col("type").isin(*types) & F.col("health_status").isin("healthy", "low_utility")).join(covered, "id", "left_anti")
    c = c.select("id", F.concat_ws("/", "type", F.coalesce("scope", F.lit(""))).alias("cohort"), score.alias("priority"), F.coalesce("observed_at", "created_at").alias("at"))
    return c


def distillation_cohort(candidates: DataFrame, least: int, most: int) -> DataFrame:
    """(cohort, id, place): of the cohorts of `least` records or more the one with the best record, then the largest,
    then the first by name; its `most` best records."""
    order = [F.desc("priority"), F.asc_nulls_first("at"), F.asc("id")]
    best = F.struct((-F.col("priority")).alias("p"), "at", "id")
    groups = candidates.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("b")).where(F.col("n") >= least)
    chosen = groups.orderBy("b.p", F.asc_nulls_first("b.at"), "b.id", F.desc("n"), "cohort").limit(1).select("cohort")
    ranked = candidates.join(chosen, "cohort", "left_semi").withColumn("place", F.row_number().over(W.partitionBy("cohort").orderBy(*order)))
    return ranked.where(F.col("place") <= most).select("cohort", "id", "place")


def decay_actions(atoms: DataFrame, edges: DataFrame, now: str, proposed_days: int = 30, ttl_days: int = 365, least_utility: float = 0.2) -> DataFrame:
    """(id, action, reason): what decay does to a record, the first rule that fits: a settled commitment is archived,
    protected types are passed over, then proposed duplicates, replaced records, proposals and records past their time."""
    a = live(atoms).where("lifecycle_state in ('active', 'proposed')").dropDuplicates(["id"])
    still_open = views.open_items(atoms, edges).select("id").withColumn("is_open", F.lit(True))
    old = scans.supersession(edges, atoms).select(F.col("ref").alias("id"), F.lit(True).alias("replaced"))
    twin = proposed_duplicates(atoms).select("id", F.lit(True).alias("twin"))
    j = a.join(still_open, "id", "left").join(old, "id", "left").join(twin, "id", "left")
    age = seconds_since(F.coalesce("updated_at", "created_at"), now) / DAY
    since = seconds_since(F.col("created_at"), now) / DAY
    proposed = F.col("lifecycle_state") == "proposed"
    reason = F.when((F.col("type") == "commitment") & (F.col("lifecycle_state") == "active") & F.col("is_open").isNull(), "settled_commitment").when(F.col("type").isin(*PROTECTED_TYPES), None)
    reason = reason.when(F.col("twin"), "duplicate_proposal").when(F.col("replaced"), "replaced").when(proposed & (since >= proposed_days), "proposal_expired")
    reason = reason.when(~proposed & (F.col("utility") < least_utility), "low_utility").when(~proposed & (age >= ttl_days), "expired")
    return j.select("id", reason.alias("reason")).where("reason is not null").select("id", F.when(F.col("reason") == "low_utility", "mark_stale").otherwise("archive").alias("action"), "reason")


def eviction_unprotected(atoms: DataFrame, edges: DataFrame, leases: DataFrame, k: int) -> DataFrame:
    """(place, id): the k records to give up first: unlinked before linked, by health, utility, salience, time and id.

    Leased records, those that replace another and protected types are never given up.
    """
    e = graph.live_edges(edges)
    heads = e.where("relation = 'rel:supersedes'").select(F.col("source_ref").alias("id"))
    kept = leases.select(F.col("target_ref").alias("id")).unionByName(heads).where("id is not null").distinct()
    health = F.coalesce(*[F.when(F.col("health_status") == h, F.lit(r)) for h, r in HEALTH_RANK.items()], F.lit(1))
    a = live(atoms).where(F.col("lifecycle_state").isin("active", "proposed") & ~F.col("type").isin(*PROTECTED_TYPES)).dropDuplicates(["id"]).join(kept, "id", "left_anti")
    linked = graph.degrees(e).select(F.col("ref").alias("id"), F.lit(1).alias("linked"))
    j = a.join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(0)).alias("linked"), health.alias("health"), F.coalesce("utility", F.lit(0.0)).alias("utility"), F.coalesce("salience", F.lit(0.0)).alias("salience"), F.coalesce("updated_at", "observed_at", "created_at").alias("at"))
    order = ["linked", "health", "utility", "salience", F.asc_nulls_first("at"), "id"]
    return j.orderBy(*order).limit(k).select(F.row_number().over(W.orderBy(*order)).alias("place"), "id")


def cleanup_order(actions: DataFrame, atoms: DataFrame, k: int) -> DataFrame:
    """The k actions on the records touched longest ago; ties by id."""
    at = live(atoms).dropDuplicates(["id"]).select("id", F.coalesce("updated_at", "observed_at", "created_at").alias("at"))
    return actions.join(at, "id").orderBy(F.asc_nulls_first("at"), "id").limit(k).drop("at")


def rotating_window(ids: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """(id, place, wrapped): the next `limit` ids behind the cursor, going on from the start when they run out."""
    t = ids.select("id").where("id is not null").distinct().withColumn("wrapped", F.col("id") <= F.lit(cursor) if cursor is not None else F.lit(False))
    return t.orderBy("wrapped", "id").limit(limit).select("id", F.row_number().over(W.orderBy("wrapped", "id")).alias("place"), "wrapped")


def evidence_window(evidence: DataFrame, atoms: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(evidence_id, referenced, place): referenced evidence first, then by time of capture; ties by id."""
    refs = live(atoms).select(F.explode("evidence_refs").alias("evidence_id")).unionByName(graph.live_edges(edges).select(F.explode("evidence_refs").alias("evidence_id"))).distinct()
    e = evidence.where("evidence_id is not null").groupBy("evidence_id").agg(F.min("captured_at").alias("at"))
    j = e.join(refs.withColumn("r", F.lit(True)), "evidence_id", "left").withColumn("referenced", F.coalesce("r", F.lit(False)))
    order = [F.desc("referenced"), F.asc_nulls_first("at"), F.asc("evidence_id")]
    return j.orderBy(*order).limit(limit).select("evidence_id", "referenced", F.row_number().over(W.orderBy(*order)).alias("place"))


def capacity(atoms: DataFrame, quota: int, headroom: float = 0.2, targets: tuple[int, ...] = (256, 512, 768)) -> DataFrame:
    """One row: hot records, their share of the quota, how many must go, whether room runs short, the quota to set."""
    n = live(atoms).where("lifecycle_state in ('active', 'proposed')").agg(F.count_distinct("id").alias("hot"))
    need = F.greatest(F.lit(1), F.ceil(F.col("hot") / F.lit(max(0.1, 1 - headroom)))).cast("bigint")
    steps = [F.lit(t).cast("bigint") for t in sorted({*targets, quota})]
    target = F.coalesce(*[F.when(t >= need, t) for t in steps], need)
    return n.select("hot", F.round(F.col("hot") / quota, 4).alias("utilisation"), F.greatest(F.lit(0), F.col("hot") - quota).alias("to_archive"), (F.col("hot") / quota >= 1 - headroom).alias("near_limit"), target.alias("recommended"))


def pressure(size: Column, budget: int, warning: float = 0.7, critical: float = 0.9) -> Column:
    """red, orange or green by the share of a budget that is used."""
    return F.when(size / budget >= critical, "red").when(size / budget >= warning, "orange").otherwise("green")


def component_summary(edges: DataFrame, top: int = 5) -> DataFrame:
    """(measure, value): connected components, the largest, the largest's share, and the share of link ends at the `top` hubs."""
    ws = Workspace(edges.sparkSession, "components")
    e = ws.save(edges.select("source_ref", "target_ref"), "links")
    sizes = ws.save(graph.components(e).groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    whole = sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("largest_share"))
    deg = ws.save(graph.degrees(e), "degrees")
    hubs = deg.orderBy(F.desc("degree"), "ref").limit(top).agg(F.sum("degree").alias("h"))
    share = hubs.select(F.lit(1).alias("j"), "h").join(deg.agg(F.sum("degree").alias("all")).withColumn("j", F.lit(1)), "j").select(F.lit("hub_share").alias("measure"), F.round(F.col("h") / F.col("all"), 6).alias("value"))
    flat = whole.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), 6).alias("value")) for m in ("components", "largest", "largest_share")])).alias("x")).select("x.*")
    return flat.unionByName(share)


def intervals(rows: DataFrame, key: str, at: str, item: str) -> DataFrame:
    """(key, item, seconds): how long after the one before it each item of a key came; the first has none."""
    w = W.partitionBy(key).orderBy(at, item)
    t = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, item).agg(F.min(at).alias(at))
    return t.select(key, item, ((F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 1e6).alias("seconds"))


def json_paths(rows: DataFrame, key: str, json: str, depth: int = 8) -> DataFrame:
    """(key, path, value): the leaves of JSON objects by dotted path. Lists are compared whole, so they are leaves, and
    so is what lies deeper than `depth`. What does not parse has none."""
    todo = rows.select(key, F.explode(F.from_json(parsed(json), "map<string,string>")).alias("path", "value"))
    out = None
    for level in range(depth):
        inner = F.from_json("value", "map<string,string>")
        nested = F.col("value").startswith("{") & (F.coalesce(F.size(inner), F.lit(0)) > 0) if level < depth - 1 else F.lit(False)
        leaves = todo.where(~F.coalesce(nested, F.lit(False)))
        out = leaves if out is None else out.unionByName(leaves)
        if level < depth - 1:
            todo = todo.where(nested).select(key, "path", F.explode(inner).alias("__k", "__v")).select(key, F.concat_ws(".", "path", "__k").alias("path"), F.col("__v").alias("value"))
    return out


def path_changes(before: DataFrame, after: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, change): fields added, removed or changed between two states of a record; records in both only."""
    both = before.select(key).intersect(after.select(key))
    b, a = (json_paths(df.join(both, key, "left_semi"), key, json, 4) for df in (before, after))
    j = b.select(key, "path", F.col("value").alias("b"), F.lit(True).alias("in_b")).join(a.select(key, "path", F.col("value").alias("a"), F.lit(True).alias("in_a")), [key, "path"], "full_outer")
    return j.select(key, "path", F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").alias("change")).where("change is not null")


def images(entries: DataFrame) -> DataFrame:
    """(atom_id, version, payload): the record images that journal entries carry, each version once."""
    one = "struct<id:string,version:bigint,payload:string>"
    p = F.from_json("payload", f"atom {one}, after {one}, projected_atoms array<{one}>")
    every = entries.select(F.explode(F.concat(F.array(p["atom"], p["after"]), F.coalesce(p["projected_atoms"], F.array().cast(f"array<{one}>")))).alias("i")).where("i.id is not null and i.version is not null")
    return every.groupBy(F.col("i.id").alias("atom_id"), F.col("i.version").alias("version")).agg(F.max("i.payload").alias("payload"))


def later_stronger(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, id, replaced): of the records of a key, each that is later and at least 0.1 more certain than the one before."""
    w = W.partitionBy(key).orderBy(at, "id")
    t = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, "id", at, "certainty", F.lag("id").over(w).alias("replaced"), F.lag(at).over(w).alias("b_at"), F.lag("certainty").over(w).alias("b_certainty"))
    return t.where((F.col(at) > F.col("b_at")) & (F.round("certainty", 9) >= F.round(F.col("b_certainty") + 0.1, 9))).select(key, "id", "replaced")


def link_candidates(index: DataFrame, atoms: DataFrame, k: int, most_common: int) -> DataFrame:
    """(id, other, place): for each record the k others with which it shares most words, those of its type first, then
    the later ones; both ways. Words of more than `most_common` records tell nothing apart and pair no records."""
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") > 1) & (F.col("df") <= most_common))
    t = index.join(df.select("token"), "token", "left_semi")
    o = t.select("token", F.col("id").alias("other"))
    pairs = t.join(o, "token").where("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("overlap"))
    kind = live(atoms).dropDuplicates(["id"]).select("id", "type", F.coalesce("updated_at", "created_at").alias("at"))
    j = pairs.join(kind.select("id", F.col("type").alias("mine")), "id").join(kind.select(F.col("id").alias("other"), "type", "at"), "other")
    w = W.partitionBy("id").orderBy(F.desc(F.col("type") == F.col("mine")), F.desc("overlap"), F.desc_nulls_last("at"), "other")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("id", "other", "place")


def calibration_of(atoms: DataFrame) -> DataFrame:
    """(agent, claims, unverified, rate): capability records without evidence that no successful outcome of the agent
    names either; the name of a capability is looked for in the outcome's payload."""
    a = live(atoms).dropDuplicates(["id"])
    c = a.where("type = 'capability'").select("id", first_filled(field("agent_id"), field("subject_agent")).alias("agent"), first_filled(field("name"), field("capability"), field("summary")).alias("name"), (F.coalesce(F.size(F.filter("evidence_refs", lambda x: F.coalesce(x, F.lit("")) != "")), F.lit(0)) <= 0).alias("bare"))
    good = a.where("type = 'action_outcome'").where(F.lower(F.coalesce(field("status"), F.lit(""))).isin("success", "succeeded")).select(first_filled(field("agent_id"), field("subject_agent")).alias("agent"), F.col("payload").alias("body"))
    hit = c.where("bare").join(good, "agent").where(F.col("body").contains(F.col("name"))).select("id").distinct().withColumn("shown", F.lit(True))
    j = c.join(hit, "id", "left").withColumn("loose", F.col("bare") & F.col("shown").isNull())
    return j.where("agent is not null").groupBy("agent").agg(F.count(F.lit(1)).alias("claims"), F.count_if("loose").alias("unverified"), F.round(F.avg(F.col("loose").cast("double")), 4).alias("rate"))


def edge_level(score: Column) -> Column:
    """A new link's level of confidence by its score: 0.85 and 0.65 are the steps."""
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium-high").otherwise("medium")


def source_refs(atoms: DataFrame) -> DataFrame:
    """(id, ref): what a record says it rests on: evidence, source and reviewed refs, hints; each ref once."""
    named = [F.from_json(field(n), "array<string>") for n in ("source_refs", "maintenance_source_refs", "reviewed_refs", "maintenance_hints.source_refs")]
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(F.coalesce("evidence_refs", none), *[F.coalesce(n, none) for n in named]))
    return live(atoms).dropDuplicates(["id"]).select("id", F.explode(F.array_distinct(every)).alias("ref")).where("ref is not null and ref <> ''")


def steward_plan(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, ref): what a steward run would do, by step: links to prune, links to isolate because an end is only
    proposed, exact copies and records of one stated key to archive."""
    ids = live(atoms).where("lifecycle_state = 'proposed'").select("id").distinct()
    e = graph.live_edges(edges).select("edge_id", "source_ref", "target_ref")
    ends = e.select("edge_id", F.explode(F.array("source_ref", "target_ref")).alias("id")).join(ids, "id", "left_semi")
    keyed = live(atoms).select("id", field("retention.deduplication_key").alias("k"), F.coalesce("utility", F.lit(0.0)).alias("u"), F.coalesce("updated_at", F.timestamp_micros(F.lit(0))).alias("at"))
    steps = {
        "isolate": ends.select("edge_id"),
        "prune": derive.edges_to_retire(edges, atoms).select("edge_id"),
        "archive_exact": quality.exact_duplicates(atoms).select("id"),
        "archive_structured": quality.keep_best(keyed, "k", "id", "u", "at").select("id"),
    }
    out = None
    for name, df in steps.items():
        part = df.toDF("ref").select(F.lit(name).alias("step"), "ref")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def proposal_order(proposals: DataFrame, k: int) -> DataFrame:
    """(source_ref, target_ref, relation, place): the first k proposals, low risk first, then by what they link."""
    order = [*([F.asc(F.col("risk") != "low")] if "risk" in proposals.columns else []), F.asc("source_ref"), F.asc("target_ref"), F.asc("relation")]
    return proposals.orderBy(*order).limit(k).select("source_ref", "target_ref", "relation", F.row_number().over(W.orderBy(*order)).alias("place"))
