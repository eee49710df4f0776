"""Queries of derived judgements, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.records import confidence, parsed
from corvane.operators import derive, graph, latent, plugins, quality, text_index
from corvane.plans.store import _CONF, A, E, atoms, docs, edges
from corvane.sources import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, CASE WHEN regexp_matches(x, 'prefer|preference|avoid|likes') THEN 'preference' WHEN regexp_matches(x, 'step|procedure|fallback|rollback') THEN 'procedure' WHEN regexp_matches(x, 'failed|blocked|success|correction') THEN 'agentic_trace' WHEN regexp_matches(x, 'should|claim|belief|is true') THEN 'belief' ELSE 'semantic' END AS label FROM (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL)")
def classify_text(s, d):
    return docs(s, d).where("text is not null").select("doc_id", derive.label(F.col("text"))[0].alias("label"))


@query(f"WITH u AS (SELECT target_ref AS id, count(*) FILTER (relation IN ('rel:supports', 'rel:uses')) AS r, count(*) FILTER (relation IN ('rel:contradicts', 'rel:corrected_by')) AS c FROM {E} GROUP BY 1) SELECT a.id, round(least(1, greatest(0, coalesce(utility, 0.5) + least(coalesce(r, 0), 10) * 0.03 - least(coalesce(c, 0), 10) * 0.05)), 6)::double AS utility, CASE WHEN coalesce(c, 0) > 0 THEN 'confounding' WHEN {_CONF} < 0.25 THEN 'low_utility' ELSE 'healthy' END AS health FROM {A} a LEFT JOIN u ON u.id = a.id")
def utility_health(s, d):
    return derive.judged(atoms(s, d), edges(s, d)).withColumn("utility", F.round("utility", 6))


@query(f"SELECT type, CASE WHEN who = 'tally-1' THEN 'self' WHEN who IS NOT NULL THEN 'other_agent' ELSE 'unknown' END AS responsibility, lower(coalesce(nullif(p->>'$.status', ''), nullif(p->>'$.outcome', ''), nullif(p->>'$.result', ''), '')) AS status, count(*) AS n FROM (SELECT type, p, coalesce(nullif(p->>'$.agent_id', ''), nullif(p->>'$.subject_agent', '')) AS who FROM (SELECT type, payload::json AS p FROM {A} WHERE json_valid(payload) AND type IN ('agentic_trace', 'action_outcome'))) GROUP BY ALL")
def recall_responsibility(s, d):
    return derive.recall(atoms(s, d).where(F.try_parse_json("payload").isNotNull()), "tally-1", ["agentic_trace", "action_outcome"])


@query(f"SELECT agent, count(*) AS claims, count(*) FILTER (bare) AS unverified, round(count(*) FILTER (bare) / count(*), 4) AS rate FROM (SELECT json_extract_string(payload, '$.agent_id') AS agent, coalesce(len(list_filter(evidence_refs, lambda x: coalesce(x, '') <> '')), 0) = 0 AS bare FROM {A} WHERE type = 'capability' AND json_valid(payload)) WHERE agent IS NOT NULL GROUP BY 1")
def calibration_rate(s, d):
    return derive.calibration(atoms(s, d).where(F.try_parse_json("payload").isNotNull()))


_STRUCT = ", ".join(f"'{r}'" for r in derive.STRUCTURAL)


@query(f"SELECT relation, CASE WHEN relation IN ({_STRUCT}) THEN 'structural' ELSE 'associative' END AS class, count(*) AS n FROM {E} GROUP BY ALL")
def relation_classes(s, d):
    e = graph.live_edges(edges(s, d))
    return e.groupBy("relation", derive.relation_class(F.col("relation")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT edge_id, source_ref, target_ref, relation FROM {E} e JOIN {A} s ON s.id = source_ref JOIN {A} t ON t.id = target_ref".replace("SELECT edge_id, source_ref, target_ref, relation", "SELECT e.edge_id, e.source_ref, e.target_ref, e.relation") + " WHERE NOT coalesce(s.lifecycle_state = 'proposed' OR t.lifecycle_state = 'proposed', false) AND (e.relation IN ('rel:derived_from', 'rel:supersedes') OR NOT coalesce(s.lifecycle_state = 'archived' OR t.lifecycle_state = 'archived', false))")
def hot_graph_edges(s, d):
    return derive.hot_edges(edges(s, d), atoms(s, d))


@query(f"WITH a AS (SELECT id, min(coalesce(deleted, false)) AS gone FROM atoms GROUP BY 1), x AS (SELECT edge_id, unnest([source_ref, target_ref]) AS id FROM {E}), w AS (SELECT edge_id, max(coalesce(gone, false)) AS gone, max(gone IS NULL) AS unknown FROM x LEFT JOIN a USING (id) GROUP BY 1) SELECT edge_id, CASE WHEN gone THEN 'deleted_end' ELSE 'unknown_end' END AS reason FROM w WHERE gone OR unknown")
def edges_to_retire(s, d):
    return derive.edges_to_retire(edges(s, d), atoms(s, d))


@query("SELECT DISTINCT edge_id FROM edges WHERE deleted AND source_ref IN (SELECT id FROM atoms WHERE NOT deleted) AND target_ref IN (SELECT id FROM atoms WHERE NOT deleted)")
def edges_to_restore(s, d):
    return derive.edges_to_restore(edges(s, d), atoms(s, d))


@query(f"WITH w AS (SELECT DISTINCT id FROM {A} WHERE lifecycle_state = 'active'), j AS (SELECT (source_ref IN (FROM w))::int + (target_ref IN (FROM w))::int AS n FROM {E}) SELECT count(*) FILTER (n = 2) AS inside, count(*) FILTER (n = 1) AS across, count(*) FILTER (n = 0) AS outside, (SELECT count(*) FROM w) AS records FROM j")
def coverage_counters(s, d):
    return derive.coverage(atoms(s, d), edges(s, d))


@query(f"SELECT relation, CASE WHEN {_CONF} >= 0.85 THEN 'high' WHEN {_CONF} >= 0.7 THEN 'medium-high' WHEN {_CONF} >= 0.45 THEN 'medium' WHEN {_CONF} >= 0.3 THEN 'low-medium' ELSE 'low' END AS level, count(*) AS n FROM {E} GROUP BY ALL")
def proposal_levels(s, d):
    return graph.live_edges(edges(s, d)).groupBy("relation", plugins.confidence_level(confidence()).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH a AS (SELECT * FROM {A} WHERE lifecycle_state = 'active') SELECT DISTINCT source_ref, target_ref, relation FROM (SELECT id AS source_ref, unnest(supersedes) AS target_ref, 'rel:supersedes' AS relation FROM a) WHERE target_ref <> source_ref AND target_ref IN (SELECT id FROM a) AND (source_ref, target_ref) NOT IN (SELECT source_ref, target_ref FROM {E} WHERE relation = 'rel:supersedes')")
def processor_proposals(s, d):
    r = plugins.Registry()
    r.register("intrinsic", plugins.missing_intrinsic_edges)
    p = plugins.committable(r.run({"atoms": atoms(s, d), "edges": edges(s, d)}))
    return p.select("source_ref", "target_ref", "relation")


@query()
def reading_frame(s, d):
    return derive.frame(atoms(s, d), edges(s, d), ["greenhouse", "quota", "ratified"], ["rel:supersedes", "rel:contradicts"], ["rel:supports", "rel:derived_from"])


@query()
def latent_token_vectors(s, d):
    v = latent.token_vectors(text_index.postings(docs(s, d), "doc_id", "text"), "doc_id")
    return v.select("token", F.size("vec").alias("components"))


@query("SELECT term_a, term_b, round(sum(1), 0)::bigint AS docs FROM (SELECT DISTINCT d, a AS term_a, b AS term_b FROM (SELECT doc_id AS d, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x IN ('quarry', 'greenhouse', 'quota', 'ratified', 'tenant')))) AS l FROM documents), (SELECT unnest(['quarry', 'greenhouse', 'quota', 'ratified', 'tenant']) AS a), (SELECT unnest(['quarry', 'greenhouse', 'quota', 'ratified', 'tenant']) AS b) WHERE a < b AND list_contains(l, a) AND list_contains(l, b)) GROUP BY ALL")
def term_cooccurrence(s, d):
    words = ["quarry", "greenhouse", "quota", "ratified", "tenant"]
    i = text_index.postings(docs(s, d), "doc_id", "text", content_only=False).where(F.col("token").isin(*words))
    per = i.groupBy("doc_id").agg(F.array_sort(F.collect_set("token")).alias("t"))  # at most as many as there are words
    pairs = per.select(F.posexplode("t").alias("i", "term_a"), "t").select("term_a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("term_b"))
    return pairs.groupBy("term_a", "term_b").agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT id, n FROM (SELECT id, (CASE WHEN payload IS NULL THEN 0 ELSE len(list_filter([p->>'$.subject', p->>'$.claim', p->>'$.summary', p->>'$.description'], lambda x: coalesce(x, '') <> '')) END)::int AS n FROM (SELECT id, payload, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM {A} WHERE payload IS NULL OR json_valid(payload)))")
def filled_fields(s, d):
    g = [F.get_json_object("payload", f"$.{f}") for f in ("subject", "claim", "summary", "description")]
    a = quality.live(atoms(s, d).where(F.col("payload").isNull() | F.try_parse_json("payload").isNotNull())).dropDuplicates(["id"])
    return a.select("id", F.size(F.filter(F.array(*g), lambda x: F.coalesce(x, F.lit("")) != "")).alias("n"))


@query(SQL["filled_fields"].replace(" WHERE payload IS NULL OR json_valid(payload)", ""))
def filled_fields_all(s, d):
    g = [F.get_json_object(parsed(), f"$.{f}") for f in ("subject", "claim", "summary", "description")]
    a = quality.live(atoms(s, d)).dropDuplicates(["id"])
    return a.select("id", F.size(F.filter(F.array(*g), lambda x: F.coalesce(x, F.lit("")) != "")).alias("n"))


@query("SELECT target_ref AS id, recreation_policy AS policy FROM (SELECT DISTINCT ON (target_ref) target_ref, recreation_policy FROM tombstones ORDER BY target_ref, created_at DESC, recreation_policy DESC) WHERE target_ref IN (SELECT id FROM atoms WHERE NOT deleted)")
def tombstone_block(s, d):
    t = table(s, d, "tombstones").groupBy(F.col("target_ref").alias("id")).agg(F.max(F.struct("created_at", F.col("recreation_policy").alias("policy"))).alias("m"))
    return t.join(quality.live(atoms(s, d)).select("id").distinct(), "id", "left_semi").select("id", "m.policy")
