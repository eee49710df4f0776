"""Queries of exact lookups, pools and windows, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.records import parsed
from corvane.functions.scopes import access_visible
from corvane.operators import archive, graph, lookup, scans, text_index
from corvane.plans.store import ASKED, A, E, _INDEX, _STOP, atoms, docs, edges, evidence, log, messages
from corvane.functions.text import REFERENCE_TOKEN
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


_IN_SCOPE = """(coalesce(json_extract_string(scope, '$.tenant') IN ('tenant-1', 'global'), json_extract_string(scope, '$.tenant') IS NULL)
    AND coalesce(json_extract_string(scope, '$.workspace') = 'global', json_extract_string(scope, '$.workspace') IS NULL))"""
_OLD = """(SELECT target_ref AS ref, string_agg(source_ref, ',' ORDER BY source_ref) AS superseded_by
  FROM (SELECT DISTINCT source_ref, target_ref FROM edges WHERE NOT coalesce(deleted, false) AND lifecycle_state = 'active' AND relation = 'rel:supersedes')
  WHERE source_ref IN (SELECT id FROM atoms WHERE NOT coalesce(deleted, false) AND lifecycle_state = 'active')
    AND target_ref IN (SELECT id FROM atoms WHERE NOT coalesce(deleted, false) AND lifecycle_state IN ('active', 'superseded')) GROUP BY 1)"""


def _lookup_sql(states: str, conflicts: bool, low: bool) -> str:
    more = "" if conflicts else " WHEN health_status = 'contradicted' THEN 'contradicted'"
    more += "" if low else " WHEN health_status IN ('confounding', 'low_utility', 'merged', 'orphaned', 'stale') THEN 'health:' || health_status"
    return f"""
WITH r AS (SELECT id AS ref FROM atoms UNION SELECT target_ref FROM edges), a AS (SELECT DISTINCT ON (id) * FROM atoms),
x AS (SELECT r.ref, o.superseded_by, CASE WHEN a.id IS NULL THEN 'not_found' WHEN a.deleted THEN 'deleted' WHEN NOT {_IN_SCOPE} THEN 'scope_hidden'
    WHEN a.lifecycle_state = 'archived' AND NOT 'archived' IN ({states}) THEN 'archived' WHEN NOT a.lifecycle_state IN ({states}) THEN 'lifecycle_hidden:' || a.lifecycle_state{more}
    WHEN o.ref IS NOT NULL THEN 'superseded' END AS reason
  FROM r LEFT JOIN a ON a.id = r.ref LEFT JOIN {_OLD} o ON o.ref = r.ref WHERE r.ref IS NOT NULL)
SELECT ref, reason, CASE WHEN reason = 'superseded' THEN superseded_by END AS superseded_by FROM x"""


def _refs(s, d):
    return atoms(s, d).select(F.col("id").alias("ref")).unionByName(edges(s, d).select(F.col("target_ref").alias("ref")))


@query(_lookup_sql("'active'", False, False))
def exact_lookup(s, d):
    return lookup.exact_records(_refs(s, d), atoms(s, d), edges(s, d), ASKED)


@query(_lookup_sql("'active', 'proposed', 'archived', 'superseded'", True, True).replace(_IN_SCOPE, _IN_SCOPE.replace("tenant-1", "tenant-0").replace("= 'global'", "IN ('global', 'ws-ledger-000')")))
def exact_lookup_history(s, d):
    return lookup.exact_records(_refs(s, d), atoms(s, d), edges(s, d), {"tenant": "tenant-0", "workspace": "ws-ledger-000"}, "historical_review", include_low_health=True)


@query(f"WITH r AS (SELECT DISTINCT unnest(evidence_refs) AS ref FROM atoms), e AS (SELECT DISTINCT ON (evidence_id) * FROM evidence) SELECT ref, CASE WHEN evidence_id IS NULL THEN 'not_found' WHEN NOT {_IN_SCOPE} THEN 'scope_hidden' END AS reason FROM r LEFT JOIN e ON evidence_id = ref WHERE ref IS NOT NULL")
def evidence_lookup(s, d):
    return lookup.exact_evidence(atoms(s, d).select(F.explode("evidence_refs").alias("ref")), evidence(s, d), ASKED)


@query(f"""
WITH r AS (SELECT unnest(evidence_refs) AS ref FROM atoms UNION SELECT target_ref FROM edges),
k AS (SELECT id AS ref, 'atom' AS k, {_IN_SCOPE} AS seen FROM atoms UNION ALL SELECT evidence_id, 'evidence', {_IN_SCOPE} FROM evidence),
g AS (SELECT ref, count(DISTINCT k) FILTER (seen) AS n, min(k) FILTER (seen) AS k FROM k GROUP BY 1)
SELECT r.ref, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN k WHEN g.ref IS NOT NULL THEN 'denied' ELSE 'unknown' END AS kind FROM r LEFT JOIN g USING (ref) WHERE r.ref IS NOT NULL""")
def reference_classify_scoped(s, d):
    refs = atoms(s, d).select(F.explode("evidence_refs").alias("ref")).unionByName(edges(s, d).select(F.col("target_ref").alias("ref")))
    return lookup.classify(refs, atoms(s, d), evidence(s, d), ASKED)


@query(f"""SELECT id, CASE WHEN coalesce(deleted, false) OR lifecycle_state IN ('deleted', 'tombstoned') THEN 'deleted' WHEN lifecycle_state NOT IN ('active', 'proposed') THEN 'lifecycle_hidden:' || lifecycle_state
  WHEN NOT {_IN_SCOPE} THEN 'scope_hidden' END AS reason FROM (SELECT DISTINCT ON (id) * FROM atoms)""")
def frame_omissions(s, d):
    return lookup.omission_reasons(atoms(s, d), ASKED, lookup.semantic_scope({}, ASKED), "deliberation")


@query("""
WITH m AS (SELECT DISTINCT id, scope, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM interaction_event WHERE id IS NOT NULL),
w AS (SELECT min(conversation_id) AS c FROM interaction_event)
SELECT id FROM m, w WHERE (p->>'$.conversation_id' IS NULL OR p->>'$.conversation_id' = 'global' OR trim(p->>'$.conversation_id') = c)""")
def thread_visible(s, d):
    m = messages(s, d).where("id is not null")
    thread = m.agg(F.min("conversation_id")).first()[0]
    return m.where(lookup.semantically_visible(lookup.semantic_scope({"conversation_id": thread or ""}, {}))).select("id").distinct()


@query("""
WITH m AS (SELECT DISTINCT id, p->>'$.visibility' AS v, p->>'$.actor_ref' AS who FROM (SELECT id, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM interaction_event) WHERE id IS NOT NULL)
SELECT id, v IS NULL OR v = 'shared' OR coalesce(who = 'keeper-7', false) AS visible FROM m""")
def message_access(s, d):
    p = parsed()
    seen = F.when(F.get_json_object(p, "$.visibility") == "shared", F.array(F.lit("all"))).when(F.get_json_object(p, "$.visibility").isNotNull(), F.array(F.coalesce(F.get_json_object(p, "$.actor_ref"), F.lit(""))))
    return messages(s, d).where("id is not null").select("id", access_visible(seen, "keeper-7", "reasoner").alias("visible")).distinct()


_WORDS = f"""
leaf AS (SELECT a.id, t.value AS v FROM (SELECT DISTINCT ON (id) id, lifecycle_state, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM {A}) a, json_tree(a.p) t WHERE a.lifecycle_state IN ('active', 'proposed') AND a.p IS NOT NULL AND t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
raw AS (SELECT id, unnest(regexp_extract_all(lower(v->>'$'), '[a-z0-9_]+')) AS w FROM leaf),
parts AS (SELECT id, w FROM raw UNION ALL SELECT id, unnest(string_split(w, '_')) FROM raw),
idx AS (SELECT DISTINCT id, w AS token FROM parts WHERE length(w) > 1 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '{REFERENCE_TOKEN}') AND NOT regexp_matches(w, '^[0-9a-f]{{12,}}$') AND NOT regexp_matches(w, '^v\\d+$'))"""


@query(f"WITH {_WORDS} SELECT * FROM idx")
def search_tokens(s, d):
    return lookup.search_index(atoms(s, d))


@query(f"""
WITH {_WORDS}, n AS (SELECT count(DISTINCT id) AS n FROM idx), f AS (SELECT token, count(*) AS df FROM idx GROUP BY 1),
top AS (SELECT id AS ref, round(sum(ln((n + 1) / (df + 1)) + 1), 9) AS score FROM idx JOIN f USING (token), n WHERE token IN ('greenhouse', 'ratified', 'quarry') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 64),
adj AS (SELECT source_ref AS a, target_ref AS b FROM {E} UNION SELECT target_ref, source_ref FROM {E}),
o AS (SELECT DISTINCT b AS ref FROM adj WHERE a IN (SELECT ref FROM top) AND b NOT IN (SELECT ref FROM top)),
w AS (SELECT DISTINCT b AS ref FROM adj WHERE a IN (SELECT ref FROM o) AND b NOT IN (SELECT ref FROM top) AND b NOT IN (SELECT ref FROM o)),
u AS (SELECT ref, 0 AS hop, score FROM top UNION ALL SELECT ref, 1, 0 FROM o UNION ALL SELECT ref, 2, 0 FROM w)
SELECT ref AS id, row_number() OVER (ORDER BY hop, score DESC, ref)::int AS place FROM u ORDER BY 2 LIMIT 128""")
def candidates_union(s, d):
    return lookup.candidate_pool(lookup.search_texts(atoms(s, d)), graph.live_edges(edges(s, d)), ["greenhouse", "ratified", "quarry"], 64)


@query(f"""
WITH {_WORDS}, n AS (SELECT count(DISTINCT id) AS n FROM idx), f AS (SELECT token, count(*) AS df FROM idx GROUP BY 1),
top AS (SELECT id AS ref, round(sum(ln((n + 1) / (df + 1)) + 1), 9) AS score FROM idx JOIN f USING (token), n WHERE token IN ('greenhouse', 'ratified', 'quarry') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 64)
SELECT edge_id, source_ref, target_ref FROM {E} WHERE relation = 'rel:contradicts' AND (source_ref IN (SELECT ref FROM top) OR target_ref IN (SELECT ref FROM top))""")
def conflicts_of_candidates(s, d):
    best = text_index.best_matches(lookup.search_texts(atoms(s, d)), "id", "text", ["greenhouse", "ratified", "quarry"], 64)
    return scans.edges_of(graph.live_edges(edges(s, d)), best.select(F.col("id").alias("ref")), ["rel:contradicts"]).select("edge_id", "source_ref", "target_ref")


@query(f"WITH {_WORDS} SELECT id, count(*) AS tokens FROM idx WHERE id IN (SELECT id FROM {A} WHERE lifecycle_state NOT IN ('proposed') AND NOT coalesce(health_status IN ('stale', 'low_utility'), false)) GROUP BY 1")
def index_pruned(s, d):
    return text_index.prune(lookup.search_index(atoms(s, d)), "id", atoms(s, d).dropDuplicates(["id"]), ["proposed"], ["stale", "low_utility"]).groupBy("id").agg(F.count(F.lit(1)).alias("tokens"))


@query("SELECT id, updated_at FROM (SELECT DISTINCT id, updated_at FROM atoms) ORDER BY updated_at DESC NULLS LAST, id LIMIT 300")
def scan_newest(s, d):
    return scans.newest(atoms(s, d).select("id", "updated_at").distinct(), 300, hot_first=False)


@query("""
WITH g AS (SELECT id FROM atoms WHERE type = 'goal'), x AS (SELECT DISTINCT edge_id, source_ref, target_ref, relation FROM edges WHERE NOT coalesce(deleted, false) AND relation IN ('rel:supports', 'rel:depends_on') AND (source_ref IN (SELECT id FROM g) OR target_ref IN (SELECT id FROM g)))
SELECT edge_id, source_ref, target_ref, (SELECT count(*) FROM x) > 40 AS truncated FROM x ORDER BY edge_id LIMIT 40""")
def edges_of_goals(s, d):
    return scans.edges_page(edges(s, d), atoms(s, d).where("type = 'goal'").select(F.col("id").alias("ref")), ["rel:supports", "rel:depends_on"], 40).select("edge_id", "source_ref", "target_ref", "truncated")


@query("SELECT edge_id, deleted FROM (SELECT DISTINCT edge_id, coalesce(deleted, false) AS deleted FROM edges WHERE lifecycle_state = 'active' UNION ALL SELECT DISTINCT edge_id, true FROM edges WHERE lifecycle_state <> 'active' AND edge_id NOT IN (SELECT edge_id FROM edges WHERE lifecycle_state = 'active'))")
def edges_with_retired(s, d):
    e = edges(s, d)
    return scans.with_retired(e.where("lifecycle_state = 'active'"), e.where("lifecycle_state <> 'active'")).select("edge_id", F.coalesce("deleted", F.lit(False)).alias("deleted")).distinct()


@query("SELECT ref, count(*) AS degree FROM (SELECT DISTINCT edge_id, unnest([source_ref, target_ref]) AS ref, unnest([0, 1]) AS side FROM edges) WHERE ref IS NOT NULL GROUP BY 1")
def degree_counts_all(s, d):
    return graph.degrees(edges(s, d).dropDuplicates(["edge_id"]))


@query("SELECT DISTINCT token, dimensions, vector_json FROM token_latent_vectors WHERE graph_version = (SELECT max(graph_version) FROM token_latent_vectors)")
def latent_at_version(s, d):
    return scans.at_version(table(s, d, "token_latent_vectors")).select("token", "dimensions", "vector_json").distinct()


@query("SELECT event_id, graph_version FROM (SELECT DISTINCT event_id, graph_version FROM event_journal_entry WHERE event_type = 'retrieval_outcome_recorded') ORDER BY graph_version DESC, event_id LIMIT 50")
def outcomes_newest(s, d):
    return scans.newest_events(log(s, d), "retrieval_outcome_recorded", 50)


_SEG = "ev AS (SELECT DISTINCT ON (event_id) event_id, graph_version, payload_digest, payload FROM event_journal_entry WHERE graph_version IS NOT NULL ORDER BY event_id, graph_version, ingested_at), top AS (SELECT max(graph_version) - 128 AS upto FROM ev), sg AS (SELECT ev.*, CASE WHEN graph_version <= upto THEN (graph_version - 1) // 512 END AS segment FROM ev, top)"


@query(f"WITH {_SEG} SELECT event_id, graph_version FROM ev ORDER BY graph_version DESC, event_id DESC LIMIT 200")
def journal_last(s, d):
    a = archive.compact(log(s, d), 512, 128, 2)
    return archive.last_events(a, 200).select("event_id", "graph_version")


@query(f"WITH {_SEG}, m AS (SELECT max(segment) AS m FROM sg) SELECT event_id, CASE WHEN segment IS NULL THEN 'live' WHEN segment > m - 2 THEN 'segment' ELSE 'receipt' END AS found_in, graph_version, payload_digest FROM sg, m")
def event_lookup(s, d):
    a = archive.compact(log(s, d), 512, 128, 2)
    return archive.find(a, log(s, d).select("event_id"))


@query(f"WITH {_SEG}, m AS (SELECT max(segment) AS m FROM sg) SELECT segment, count(*) AS events, true AS intact FROM sg, m WHERE segment > m - 2 GROUP BY 1")
def segment_check(s, d):
    return archive.check(archive.compact(log(s, d), 512, 128, 2)).select("segment", "events", "intact")


@query(f"WITH {_SEG}, m AS (SELECT max(segment) AS m FROM sg) SELECT segment, count(*) AS receipts, min(graph_version) AS from_version, max(graph_version) AS to_version FROM sg, m WHERE segment <= m - 2 GROUP BY 1")
def segment_receipts(s, d):
    r = archive.verified_receipts(archive.compact(log(s, d), 512, 128, 2))
    return r.groupBy("segment").agg(F.count(F.lit(1)).alias("receipts"), F.min("graph_version").alias("from_version"), F.max("graph_version").alias("to_version"))


@query(f"WITH {_SEG}, m AS (SELECT max(segment) AS m FROM sg) SELECT CASE WHEN segment IS NULL THEN 'live' WHEN segment > m - 2 THEN 'compacted' ELSE 'digest_only' END AS storage, count(*) AS events, sum(CASE WHEN segment IS NULL OR segment > m - 2 THEN strlen(payload) ELSE 0 END)::bigint AS payload_bytes FROM sg, m GROUP BY 1")
def journal_storage_status(s, d):
    return archive.status(archive.compact(log(s, d), 512, 128, 2))


@query(f"""
WITH c AS (SELECT *, coalesce(binds, false) AS b FROM {A} a LEFT JOIN (SELECT DISTINCT id AS i, true AS binds FROM (SELECT target_ref AS id FROM {E} WHERE relation IN ('rel:constrained_by', 'rel:requires') UNION SELECT source_ref FROM {E} WHERE relation = 'rel:forbids')) ON i = a.id),
o AS (SELECT DISTINCT target_ref AS id FROM {E} WHERE relation = 'rel:supersedes'),
x AS (SELECT id, type, lifecycle_state AS l, coalesce(health_status = 'contradicted', false) AS k, type = 'episode' AS story, id IN (SELECT id FROM o) AS old,
  b OR type IN ('limitation', 'policy') OR (type = 'preference' AND coalesce(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.polarity') END IN ('require', 'requires', 'forbid', 'forbids'), false)) AS lim FROM c)
SELECT id, CASE WHEN lim THEN 'constraint' WHEN NOT story AND NOT old AND l = 'active' AND NOT k THEN 'active_conclusion' WHEN NOT story AND l IN ('archived', 'superseded') THEN 'rejected_or_superseded'
  WHEN NOT story AND k THEN 'contested_conclusion' WHEN NOT story AND l = 'proposed' THEN 'candidate_conclusion' WHEN type = 'commitment' THEN 'commitment' ELSE 'history' END AS role FROM x""")
def conclusion_roles(s, d):
    return lookup.conclusions(atoms(s, d), edges(s, d))
