"""Queries of upkeep, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.records import confidence
from corvane.operators import graph, lookup, quality, upkeep, views
from corvane.plans.reads import _WORDS
from corvane.plans.store import _CONF, _DEG, NOW, A, E, atoms, edges, evidence, log, messages
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


_P = f"(SELECT *, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM {A})"


@query(f"""
WITH a AS (SELECT id, type, coalesce(scope, '') AS sc, p->>'$.retention.deduplication_key' AS k, -coalesce(len(evidence_refs), 0) AS n, created_at FROM {_P} WHERE lifecycle_state = 'active')
SELECT id, kept FROM (SELECT id, first_value(id) OVER (PARTITION BY type, sc, k ORDER BY n, created_at NULLS FIRST, id) AS kept FROM a WHERE k <> '') WHERE id <> kept""")
def keyed_duplicates(s, d):
    """The rule for proposals, over active records: hardly any proposals share a key."""
    return upkeep.proposed_duplicates(atoms(s, d), "active")


_CAND = f"""c AS (SELECT id, concat_ws('/', type, coalesce(scope, '')) AS cohort, coalesce(observed_at, created_at) AS t,
  (CASE WHEN lower(coalesce(nullif(p->>'$.outcome', ''), nullif(p->>'$.status', ''))) NOT IN ('issued', 'pending', 'planned', 'started') THEN 4 ELSE 0 END + CASE WHEN coalesce(nullif(p->>'$.summary', ''), nullif(p->>'$.claim', '')) IS NOT NULL THEN 1 ELSE 0 END)::int AS priority
  FROM {_P} WHERE lifecycle_state = 'active' AND type IN ('agentic_trace', 'action_outcome', 'episode', 'belief') AND health_status IN ('healthy', 'low_utility'))"""
_TYPES = ["agentic_trace", "action_outcome", "episode", "belief"]


@query(f"WITH {_CAND} SELECT id, cohort, priority FROM c")
def distill_candidates(s, d):
    return upkeep.distillation_candidates(atoms(s, d), _TYPES).select("id", "cohort", "priority")


@query(f"""WITH {_CAND}, r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, t NULLS FIRST, id) AS n FROM c),
g AS (SELECT cohort FROM r GROUP BY 1 HAVING count(*) >= 6 ORDER BY min(n), count(*) DESC, cohort LIMIT 1)
SELECT cohort, id, row_number() OVER (ORDER BY n)::int AS place FROM r WHERE cohort IN (SELECT cohort FROM g) QUALIFY place <= 10""")
def distill_cohort(s, d):
    return upkeep.distillation_cohort(upkeep.distillation_candidates(atoms(s, d), _TYPES), 6, 10)


@query(f"""
WITH {_CAND}, r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, t NULLS FIRST, id) AS n FROM c),
g AS (SELECT cohort FROM r GROUP BY 1 HAVING count(*) >= 6 ORDER BY min(n), count(*) DESC, cohort LIMIT 1),
m AS (SELECT id, row_number() OVER (ORDER BY n) AS place FROM r WHERE cohort IN (SELECT cohort FROM g) QUALIFY place <= 10),
h AS (SELECT place, type, m.id || ': ' || coalesce(nullif(p->>'$.summary', ''), nullif(p->>'$.claim', ''), payload) AS x FROM m JOIN {_P} USING (id)),
s AS (SELECT place, type, trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS x FROM h)
SELECT count(*) AS sources, string_agg(DISTINCT type, ', ') AS types, string_agg(CASE WHEN length(x) <= 180 THEN x ELSE rtrim(substr(x, 1, 177)) || '...' END, '; ' ORDER BY place) FILTER (place <= 6) AS highlights FROM s""")
def distill_summary(s, d):
    chosen = upkeep.distillation_cohort(upkeep.distillation_candidates(atoms(s, d), _TYPES), 6, 10)
    return quality.highlights(chosen, atoms(s, d), 6, 180)


_OPEN = f"(SELECT id FROM {A} WHERE type = 'commitment' AND lifecycle_state = 'active' AND id NOT IN (SELECT target_ref FROM {E} WHERE relation IN ('rel:closes', 'rel:produced_outcome')))"


@query(f"""
WITH t AS (SELECT id FROM (SELECT id, first_value(id) OVER (PARTITION BY type, coalesce(scope, ''), p->>'$.retention.deduplication_key' ORDER BY -coalesce(len(evidence_refs), 0), created_at NULLS FIRST, id) AS kept FROM {_P} WHERE lifecycle_state = 'proposed' AND p->>'$.retention.deduplication_key' <> '') WHERE id <> kept),
o AS (SELECT target_ref AS id FROM {E} WHERE relation = 'rel:supersedes' AND source_ref IN (SELECT id FROM {A} WHERE lifecycle_state = 'active') AND target_ref IN (SELECT id FROM {A} WHERE lifecycle_state IN ('active', 'superseded'))),
x AS (SELECT *, greatest(0, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(coalesce(updated_at, created_at)))::bigint) / 86400.0 AS age, greatest(0, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(created_at))::bigint) / 86400.0 AS since FROM {A} WHERE lifecycle_state IN ('active', 'proposed')),
r AS (SELECT id, CASE WHEN type = 'commitment' AND lifecycle_state = 'active' AND id NOT IN {_OPEN} THEN 'settled_commitment' WHEN type IN ('adjudication', 'commitment', 'covenant', 'policy', 'primal_guidance', 'self_model') THEN NULL
  WHEN id IN (SELECT id FROM t) THEN 'duplicate_proposal' WHEN id IN (SELECT id FROM o) THEN 'replaced' WHEN lifecycle_state = 'proposed' AND since >= 30 THEN 'proposal_expired'
  WHEN lifecycle_state = 'active' AND utility < 0.2 THEN 'low_utility' WHEN lifecycle_state = 'active' AND age >= 365 THEN 'expired' END AS reason FROM x)
SELECT id, CASE reason WHEN 'low_utility' THEN 'mark_stale' ELSE 'archive' END AS action, reason FROM r WHERE reason IS NOT NULL""")
def decay_actions(s, d):
    return upkeep.decay_actions(atoms(s, d), edges(s, d), NOW)


@query(f"""
WITH kept AS (SELECT source_ref AS id FROM {E} WHERE relation = 'rel:supersedes' UNION SELECT target_ref FROM {E} WHERE relation = 'rel:governed_by'),
x AS (SELECT id, (id IN (SELECT ref FROM {_DEG}))::int AS linked, CASE health_status WHEN 'low_utility' THEN 0 WHEN 'orphaned' THEN 0 WHEN 'stale' THEN 0 WHEN 'healthy' THEN 2 ELSE 1 END AS h, coalesce(utility, 0) AS u, coalesce(salience, 0) AS sa, coalesce(updated_at, observed_at, created_at) AS t
  FROM {A} WHERE lifecycle_state IN ('active', 'proposed') AND type NOT IN ('adjudication', 'commitment', 'covenant', 'policy', 'primal_guidance', 'self_model') AND id NOT IN (SELECT id FROM kept))
SELECT row_number() OVER (ORDER BY linked, h, u, sa, t NULLS FIRST, id)::int AS place, id FROM x ORDER BY 1 LIMIT 256""")
def evict_unprotected(s, d):
    leases = graph.live_edges(edges(s, d)).where("relation = 'rel:governed_by'").select("target_ref")
    return upkeep.eviction_unprotected(atoms(s, d), edges(s, d), leases, 256)


@query(f"""
WITH x AS (SELECT id, coalesce(updated_at, observed_at, created_at) AS t, lifecycle_state AS l, health_status AS h, greatest(0, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(coalesce(updated_at, created_at)))::bigint) / 86400.0 AS x FROM {A}),
y AS (SELECT id, t, CASE WHEN l = 'archived' AND x >= 7 THEN 'delete_archived' WHEN l = 'superseded' AND x >= 7 THEN 'delete_superseded' WHEN h = 'stale' AND x >= 14 THEN 'delete_stale' END AS action FROM x)
SELECT id, action FROM y WHERE action IS NOT NULL ORDER BY t NULLS FIRST, id LIMIT 256""")
def cleanup_order(s, d):
    return upkeep.cleanup_order(quality.retention_actions(atoms(s, d), NOW), atoms(s, d), 256)


@query(f"WITH a AS (SELECT DISTINCT id FROM {A}) SELECT id, row_number() OVER (ORDER BY id <= 'mem_c', id)::int AS place, id <= 'mem_c' AS wrapped FROM a ORDER BY 2 LIMIT 600")
def steward_window(s, d):
    return upkeep.rotating_window(quality.live(atoms(s, d)), "mem_c", 600)


@query(f"""
WITH r AS (SELECT unnest(evidence_refs) AS ref FROM {A} UNION SELECT unnest(evidence_refs) FROM {E}), e AS (SELECT evidence_id, min(captured_at) AS t FROM evidence GROUP BY 1)
SELECT evidence_id, ref IS NOT NULL AS referenced, row_number() OVER (ORDER BY ref IS NULL, t NULLS FIRST, evidence_id)::int AS place FROM e LEFT JOIN r ON ref = evidence_id ORDER BY 3 LIMIT 1000""")
def evidence_window(s, d):
    return upkeep.evidence_window(evidence(s, d), atoms(s, d), edges(s, d), 1000)


@query(f"""
WITH h AS (SELECT count(DISTINCT id) AS hot FROM {A} WHERE lifecycle_state IN ('active', 'proposed'))
SELECT hot, round(hot / 512, 4) AS utilisation, greatest(0, hot - 512) AS to_archive, hot / 512 >= 0.8 AS near_limit, coalesce(CASE WHEN 256 >= ceil(hot / 0.8) THEN 256 END, CASE WHEN 512 >= ceil(hot / 0.8) THEN 512 END, CASE WHEN 768 >= ceil(hot / 0.8) THEN 768 END, ceil(hot / 0.8))::bigint AS recommended FROM h""")
def capacity_assessment(s, d):
    return upkeep.capacity(atoms(s, d), 512)


@query("SELECT actor, CASE WHEN b / 60000 >= 0.9 THEN 'red' WHEN b / 60000 >= 0.7 THEN 'orange' ELSE 'green' END AS pressure FROM (SELECT actor, sum(strlen(payload)) AS b FROM (SELECT DISTINCT actor, event_id, payload FROM event_journal_entry) GROUP BY 1)")
def storage_pressure(s, d):
    e = log(s, d).select("actor", "event_id", "payload").distinct().groupBy("actor").agg(F.sum(F.octet_length("payload")).alias("b"))
    return e.select("actor", upkeep.pressure(F.col("b"), 60_000).alias("pressure"))


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT source_ref AS a, target_ref AS b FROM edges WHERE relation = 'rel:similar_to' AND source_ref IS NOT NULL AND target_ref IS NOT NULL),
adj AS (SELECT a, b FROM n UNION SELECT b, a FROM n UNION SELECT a, a FROM n UNION SELECT b, b FROM n), r AS (SELECT a AS ref, a AS o FROM adj UNION SELECT r.ref, adj.b FROM r JOIN adj ON r.o = adj.a),
c AS (SELECT ref, min(o) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1),
dg AS (SELECT ref, count(*) AS d FROM (SELECT source_ref AS ref FROM edges WHERE relation = 'rel:similar_to' UNION ALL SELECT target_ref FROM edges WHERE relation = 'rel:similar_to') WHERE ref IS NOT NULL GROUP BY 1)
SELECT 'components' AS measure, count(*)::double AS value FROM s UNION ALL SELECT 'largest', max(n)::double FROM s UNION ALL SELECT 'largest_share', round(max(n) / sum(n), 6) FROM s
UNION ALL SELECT 'hub_share', round((SELECT sum(d) FROM (SELECT d FROM dg ORDER BY d DESC, ref LIMIT 5)) / (SELECT sum(d) FROM dg), 6)""")
def component_summary(s, d):
    return upkeep.component_summary(edges(s, d).where("relation = 'rel:similar_to'"))


@query("""
WITH t AS (SELECT ref, event_id, min(accepted_at) AS t FROM (SELECT unnest(target_refs) AS ref, event_id, accepted_at FROM event_journal_entry) WHERE ref IS NOT NULL AND accepted_at IS NOT NULL GROUP BY ALL)
SELECT ref, event_id, (epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY ref ORDER BY t, event_id)) / 1e6 AS seconds FROM t""")
def event_intervals(s, d):
    e = log(s, d).select(F.explode("target_refs").alias("ref"), "event_id", "accepted_at")
    return upkeep.intervals(e, "ref", "accepted_at", "event_id")


_IMG = """
j AS (SELECT CASE WHEN json_valid(payload) THEN payload::json END AS p FROM event_journal_entry),
i AS (SELECT p->'$.atom' AS x FROM j UNION ALL SELECT p->'$.after' FROM j UNION ALL SELECT unnest((p->'$.projected_atoms')::json[]) FROM j),
v AS (SELECT x->>'$.id' AS atom_id, TRY_CAST(x->>'$.version' AS bigint) AS version, max((x->'$.payload')::varchar) AS payload FROM i WHERE x->>'$.id' IS NOT NULL AND TRY_CAST(x->>'$.version' AS bigint) IS NOT NULL GROUP BY ALL)"""


@query(f"""
WITH {_IMG}, w AS (SELECT atom_id || '@' || version AS k, atom_id || '@' || (version - 1) AS b, payload::json AS p FROM v),
f AS (SELECT k, b, e.key AS path, (e.value->>'$') AS x FROM w, json_each(w.p) e),
pairs AS (SELECT w.k, w.b FROM w JOIN w u ON u.k = w.b),
x AS (SELECT coalesce(n.k, o.k2) AS k, coalesce(n.path, o.path) AS path, n.x AS nx, o.x AS ox, n.k IS NOT NULL AS inn, o.k2 IS NOT NULL AS ino
  FROM (SELECT f.* FROM f SEMI JOIN pairs ON pairs.k = f.k) n FULL JOIN (SELECT pairs.k AS k2, f.path, f.x FROM pairs JOIN f ON f.k = pairs.b) o ON n.k = o.k2 AND n.path = o.path)
SELECT k, path, CASE WHEN NOT ino THEN 'added' WHEN NOT inn THEN 'removed' ELSE 'changed' END AS change FROM x WHERE NOT ino OR NOT inn OR nx IS DISTINCT FROM ox""")
def payload_changes(s, d):
    v = upkeep.images(log(s, d))
    at = lambda n: v.select(F.concat_ws("@", "atom_id", F.col("version") + n).alias("k"), "payload")
    return upkeep.path_changes(at(1), at(0), "k", "payload")


@query(f"""
WITH g AS (SELECT DISTINCT ON (id) id, p->>'$.retention.deduplication_key' AS k, updated_at AS t, {_CONF} AS c FROM {_P}),
w AS (SELECT k, id, t, c, lag(id) OVER q AS b, lag(t) OVER q AS bt, lag(c) OVER q AS bc FROM g WHERE k IS NOT NULL AND t IS NOT NULL WINDOW q AS (PARTITION BY k ORDER BY t, id))
SELECT k, id, b AS replaced FROM w WHERE t > bt AND round(c, 9) >= round(bc + 0.1, 9)""")
def later_stronger(s, d):
    a = quality.live(atoms(s, d)).dropDuplicates(["id"]).select("id", upkeep.field("retention.deduplication_key").alias("k"), "updated_at", confidence().alias("certainty"))
    return upkeep.later_stronger(a, "k", "updated_at")


@query(f"""
WITH {_WORDS}, f AS (SELECT token FROM idx GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60), t AS (SELECT * FROM idx WHERE token IN (SELECT token FROM f)),
p AS (SELECT a.id, b.id AS other, count(*) AS n FROM t a JOIN t b ON a.token = b.token AND a.id <> b.id GROUP BY ALL),
k AS (SELECT id, type, coalesce(updated_at, created_at) AS t FROM {A})
SELECT p.id, other, row_number() OVER (PARTITION BY p.id ORDER BY (m.type = o.type) DESC, n DESC, o.t DESC NULLS LAST, other)::int AS place FROM p JOIN k m ON m.id = p.id JOIN k o ON o.id = other QUALIFY place <= 24""")
def link_candidates(s, d):
    return upkeep.link_candidates(lookup.search_index(atoms(s, d)), atoms(s, d), 24, 60)


@query(f"""
WITH c AS (SELECT id, coalesce(nullif(p->>'$.agent_id', ''), nullif(p->>'$.subject_agent', '')) AS agent, coalesce(nullif(p->>'$.name', ''), nullif(p->>'$.capability', ''), nullif(p->>'$.summary', '')) AS name, coalesce(len(list_filter(evidence_refs, lambda x: coalesce(x, '') <> '')), 0) = 0 AS bare FROM {_P} WHERE type = 'capability'),
g AS (SELECT coalesce(nullif(p->>'$.agent_id', ''), nullif(p->>'$.subject_agent', '')) AS agent, payload FROM {_P} WHERE type = 'action_outcome' AND lower(p->>'$.status') IN ('success', 'succeeded')),
x AS (SELECT agent, bare AND NOT EXISTS (SELECT 1 FROM g WHERE g.agent = c.agent AND contains(g.payload, c.name)) AS loose FROM c WHERE agent IS NOT NULL)
SELECT agent, count(*) AS claims, count(*) FILTER (loose) AS unverified, round(avg(loose::double), 4) AS rate FROM x GROUP BY 1""")
def calibration_outcomes(s, d):
    return upkeep.calibration_of(atoms(s, d))


@query(f"SELECT DISTINCT edge_id, CASE WHEN {_CONF} >= 0.85 THEN 'high' WHEN {_CONF} >= 0.65 THEN 'medium-high' ELSE 'medium' END AS level FROM edges")
def edge_levels(s, d):
    return edges(s, d).select("edge_id", upkeep.edge_level(confidence()).alias("level")).distinct()


@query(f"SELECT DISTINCT id, ref FROM (SELECT id, unnest(evidence_refs) AS ref FROM {_P} UNION ALL SELECT id, unnest(CASE WHEN json_type(p, '$.source_refs') = 'ARRAY' THEN (p->>'$.source_refs[*]') ELSE [] END) FROM {_P}) WHERE ref <> ''")
def record_source_refs(s, d):
    return upkeep.source_refs(atoms(s, d))


_MSGS = "(SELECT DISTINCT coalesce(conversation_id, p->>'$.conversation_id') AS conversation_id, coalesce(sequence, TRY_CAST(p->>'$.sequence' AS bigint)) AS sequence, id FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM interaction_event) WHERE id IS NOT NULL)"


@query(f"""
WITH m AS (SELECT * FROM {_MSGS} WHERE conversation_id IS NOT NULL AND sequence > 5), r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence, id) AS n, count(*) OVER (PARTITION BY conversation_id) AS c FROM m)
SELECT conversation_id, sequence, id, c > 20 AS has_more FROM r WHERE n <= 20""")
def conversation_pages(s, d):
    return views.pages(views.projection(messages(s, d)), 5, 20)


@query("SELECT canonical_relation, count(*) AS names, count(*) FILTER (inverse) AS inverses, count(*) FILTER (deprecated) AS deprecated FROM relation_dictionary GROUP BY 1")
def ontology_snapshot(s, d):
    return quality.ontology(table(s, d, "relation_dictionary"))
