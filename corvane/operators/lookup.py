"""Exact lookups with reasons, candidate pools, text of payload values, and the classes of conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.records import parsed
from corvane.functions.scopes import access_visible, scope_map, scope_visible
from corvane.operators import graph, scans, text_index
from corvane.operators.quality import live
from corvane.session import Workspace

#: Lifecycle states a reader may see, by mode; relations that bind two records into one unit, and
#: those that only give context; fields that tag a record with a person, a project or a thread.
MODES = {"operational_recall": ("active",), "deliberation": ("active", "proposed"), "historical_review": ("active", "proposed", "archived", "superseded")}
MANDATORY = (
    "rel:adjudicates", "rel:applies_to", "rel:caused_by", "rel:constrained_by", "rel:contradicts", "rel:corrected_by", "rel:decided", "rel:depends_on", "rel:derived_from",
    "rel:forbids", "rel:governed_by", "rel:part_of", "rel:produced_outcome", "rel:requires", "rel:ratified_by", "rel:satisfied_commitment", "rel:supersedes",
)
SUPPORTING = (
    "rel:acted_on", "rel:attributed_to", "rel:avoids", "rel:currently_available", "rel:currently_denied", "rel:has_capability", "rel:has_limitation", "rel:miscalibrated_on",
    "rel:owns", "rel:prefers", "rel:preserves_dissent", "rel:shared_responsibility_for", "rel:similar_to", "rel:supports", "rel:uses", "rel:working_on",
)
SEMANTIC_FIELDS = {"human_id": ("human_id", "human", "user_id"), "project_id": ("project_id", "project"), "project_thread_id": ("project_thread_id", "conversation_id", "thread_id", "thread")}


def lifecycle_states(mode: str, include_archived: bool = False) -> list[str]:
    """The lifecycle states a mode shows; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    return [*MODES[mode], *(["archived"] if include_archived and "archived" not in MODES[mode] else [])]


def _may_read(df: DataFrame, requester: str, processor: str) -> Column:
    """By the column `visibility`, where the table has one; else everybody may."""
    return access_visible(F.col("visibility"), requester, processor) if "visibility" in df.columns else F.lit(True)


def exact_records(refs: DataFrame, atoms: DataFrame, edges: DataFrame, asked: dict[str, str], mode: str = "operational_recall", requester: str = "system", processor: str = "reasoner", include_conflicts: bool = False, include_archived: bool = False, include_low_health: bool = False, include_superseded: bool = False) -> DataFrame:
    """(ref, reason, superseded_by): for each ref whether the record is given (null) or the first reason why not:
    not_found, deleted, scope_hidden, access_hidden, archived, lifecycle_hidden:<state>, contradicted, health:<state>,
    superseded. The two reviewing modes show conflicts."""
    shown = lifecycle_states(mode, include_archived)
    a = atoms.where("id is not null").dropDuplicates(["id"])
    a = a.select(F.col("id").alias("ref"), F.lit(True).alias("there"), "deleted", F.coalesce("lifecycle_state", F.lit("active")).alias("state"), "health_status", scope_visible(scope_map(), asked).alias("in_scope"), _may_read(a, requester, processor).alias("may"))
    j = refs.where("ref is not null").select("ref").distinct().join(a, "ref", "left").join(scans.supersession(edges, atoms), "ref", "left")
    reason = F.when(F.col("there").isNull(), "not_found").when(F.coalesce("deleted", F.lit(False)), "deleted").when(~F.col("in_scope"), "scope_hidden").when(~F.col("may"), "access_hidden")
    reason = reason.when(~F.col("state").isin(*shown), F.when(F.col("state") == "archived", "archived").otherwise(F.concat(F.lit("lifecycle_hidden:"), "state")))
    if not (include_conflicts or mode in ("deliberation", "historical_review")):
        reason = reason.when(F.col("health_status") == "contradicted", "contradicted")
    if not include_low_health:
        reason = reason.when(F.col("health_status").isin(*scans.LOW_HEALTH), F.concat(F.lit("health:"), "health_status"))
    if not include_superseded:
        reason = reason.when(F.col("superseded_by").isNotNull(), "superseded")
    return j.select("ref", reason.alias("reason"), F.when(reason == "superseded", F.col("superseded_by")).alias("superseded_by"))


def exact_evidence(refs: DataFrame, evidence: DataFrame, asked: dict[str, str], requester: str = "system", processor: str = "reasoner") -> DataFrame:
    """(ref, reason): for each ref whether the evidence is given (null), or not_found, scope_hidden or access_hidden."""
    e = evidence.where("evidence_id is not null").dropDuplicates(["evidence_id"])
    e = e.select(F.col("evidence_id").alias("ref"), F.lit(True).alias("there"), scope_visible(scope_map(), asked).alias("in_scope"), _may_read(e, requester, processor).alias("may"))
    reason = F.when(F.col("there").isNull(), "not_found").when(~F.col("in_scope"), "scope_hidden").when(~F.col("may"), "access_hidden")
    return refs.where("ref is not null").select("ref").distinct().join(e, "ref", "left").select("ref", reason.alias("reason"))


def classify(refs: DataFrame, atoms: DataFrame, evidence: DataFrame, asked: dict[str, str], requester: str = "system", processor: str = "reasoner") -> DataFrame:
    """(ref, kind): atom, evidence, ambiguous, denied (it exists but the reader may see none of it) or unknown."""
    side = lambda df, key, kind: df.select(F.col(key).alias("ref"), F.lit(kind).alias("k"), (scope_visible(scope_map(), asked) & _may_read(df, requester, processor)).alias("seen"))
    known = side(atoms, "id", "atom").unionByName(side(evidence, "evidence_id", "evidence")).where("ref is not null")
    g = known.groupBy("ref").agg(F.min(F.when(F.col("seen"), F.col("k"))).alias("a"), F.max(F.when(F.col("seen"), F.col("k"))).alias("z"), F.lit(True).alias("there"))
    kind = F.when(F.col("a") != F.col("z"), "ambiguous").when(F.col("a").isNotNull(), F.col("a")).when(F.col("there"), "denied").otherwise("unknown")
    return refs.where("ref is not null").select("ref").distinct().join(g, "ref", "left").select("ref", kind.alias("kind"))


def semantic_scope(context: dict[str, str], asked: dict[str, str]) -> dict[str, str]:
    """The person, project and thread a reader works for: from the request's scope and a trusted context, which must agree."""
    out: dict[str, str] = {}
    for name, fields in SEMANTIC_FIELDS.items():
        said = {str(x).strip() for src in (context, asked) for f in fields if (x := src.get(f)) not in (None, "", "global")}
        if len(said) > 1:
            raise ValueError(f"{name} is stated as {sorted(said)}")
        if said:
            out[name] = said.pop()
    return out


def semantically_visible(expected: dict[str, str], scope: str = "scope", payload: str = "payload") -> Column:
    """A tag in scope or payload hides a record unless it is the one expected or global; what has no tag is visible."""
    ok = F.lit(True)
    body = parsed(payload)
    for name, fields in SEMANTIC_FIELDS.items():
        for src in (F.col(scope), body):
            for f in fields:
                raw = F.get_json_object(src, f"$.{f}")
                fits = F.trim(raw) == F.lit(expected[name]) if name in expected else F.lit(False)
                ok = ok & F.coalesce(raw.isNull() | (raw == "global") | fits, F.lit(False))
    return ok


def omission_reasons(records: DataFrame, asked: dict[str, str], expected: dict[str, str], mode: str, requester: str = "system", processor: str = "reasoner") -> DataFrame:
    """(id, reason): why a record is no part of a frame: deleted, lifecycle_hidden:<state>, semantic_scope_hidden,
    scope_hidden, access_hidden; null if it may be."""
    state = F.coalesce("lifecycle_state", F.lit("active"))
    reason = F.when(F.coalesce("deleted", F.lit(False)) | state.isin("deleted", "tombstoned") | F.coalesce(F.col("health_status") == "deleted", F.lit(False)), "deleted")
    reason = reason.when(~state.isin(*lifecycle_states(mode)), F.concat(F.lit("lifecycle_hidden:"), state)).when(~semantically_visible(expected), "semantic_scope_hidden")
    reason = reason.when(~scope_visible(scope_map(), asked), "scope_hidden").when(~_may_read(records, requester, processor), "access_hidden")
    return records.where("id is not null").dropDuplicates(["id"]).select("id", reason.alias("reason"))


def value_text(payload: Column, depth: int = 3) -> Column:
    """The values of a JSON object as one text, keys and empty values left out; nested objects and lists to `depth`."""
    obj, arr = F.from_json(payload, "map<string,string>"), F.from_json(payload, "array<string>")
    values = F.when(payload.startswith("["), arr).when(payload.startswith("{"), F.map_values(obj))
    if depth > 1:
        text = F.array_join(F.filter(F.transform(values, lambda x: F.when(x.startswith("{") | x.startswith("["), value_text(x, depth - 1)).otherwise(x)), lambda x: x.isNotNull() & (x != "")), " ")
    else:
        text = F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), " ")
    return F.coalesce(text, payload)


def search_texts(atoms: DataFrame, lifecycle: tuple[str, ...] = ("active", "proposed")) -> DataFrame:
    """(id, text): the payload values of live records that are searched; archived ones are not."""
    a = live(atoms).where(F.col("lifecycle_state").isin(*lifecycle)).dropDuplicates(["id"])
    return a.select("id", value_text(parsed()).alias("text"))


def search_index(atoms: DataFrame, lifecycle: tuple[str, ...] = ("active", "proposed")) -> DataFrame:
    """(id, token): content tokens of search_texts()."""
    return text_index.postings(search_texts(atoms, lifecycle), "id", "text")


def candidate_pool(texts: DataFrame, edges: DataFrame, cues: list[str], limit: int) -> DataFrame:
    """(id, place): the `limit` best records by words, then their neighbours, then the neighbours of these, each once;
    2 * limit in all. Hops are ordered by id."""
    ws = Workspace(texts.sparkSession, "pool")
    direct = ws.save(text_index.best_matches(texts, "id", "text", cues, limit), "direct").select(F.col("id").alias("ref"), F.round("score", 9).alias("score"))
    edges = ws.save(edges.select("source_ref", "target_ref"), "links")
    near = graph.neighbours(edges, direct.select("ref"), 2).where("hop > 0").select("ref", "hop", F.lit(0.0).alias("score"))
    both = direct.select("ref", F.lit(0).alias("hop"), "score").unionByName(near).orderBy("hop", F.desc("score"), "ref").limit(2 * limit)
    return both.select(F.col("ref").alias("id"), F.row_number().over(graph.W.orderBy("hop", F.desc("score"), "ref")).alias("place"))


def conclusions(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, role): what a record is to a reader who weighs it with its links: constraint, active_conclusion,
    rejected_or_superseded, contested_conclusion, candidate_conclusion, commitment or history.

    A record that another constrains or requires, or that forbids another, is a constraint, as are some types.
    """
    a = live(atoms).dropDuplicates(["id"]).select("id", "type", "lifecycle_state", "health_status", F.get_json_object(parsed(), "$.polarity").alias("polarity"))
    e = graph.live_edges(edges).select("source_ref", "target_ref", "relation")
    bound = e.where("relation in ('rel:constrained_by', 'rel:requires')").select(F.col("target_ref").alias("id")).unionByName(e.where("relation = 'rel:forbids'").select(F.col("source_ref").alias("id"))).distinct().withColumn("binds", F.lit(True))
    old = e.where("relation = 'rel:supersedes'").select(F.col("target_ref").alias("id")).distinct().withColumn("replaced", F.lit(True))
    j = a.join(bound, "id", "left").join(old, "id", "left")
    limits = F.col("type").isin("covenant", "limitation", "policy", "primal_guidance") | ((F.col("type") == "preference") & F.coalesce(F.col("polarity").isin("require", "requires", "forbid", "forbids"), F.lit(False))) | F.col("binds").isNotNull()
    past, contested, story = F.col("lifecycle_state").isin("archived", "superseded"), F.coalesce(F.col("health_status") == "contradicted", F.lit(False)), F.col("type").isin("adjudication", "episode")
    active = ~story & F.col("replaced").isNull() & (F.col("lifecycle_state") == "active") & ~contested
    role = F.when(F.coalesce(limits, F.lit(False)), "constraint").when(active, "active_conclusion")
    role = role.when(~story & past, "rejected_or_superseded").when(~story & contested, "contested_conclusion").when(~story & (F.col("lifecycle_state") == "proposed"), "candidate_conclusion")
    return j.select("id", role.when(F.col("type") == "commitment", "commitment").otherwise("history").alias("role"))
