"""Queries over whole tables, broken payloads included, of frames and of commands, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import scopes
from corvane.operators import changes, commands, derive, graph, journal, latent, lookup, quality, text_index, upkeep, views
from corvane.plans import derived, problems, store
from corvane.plans.store import _SELF, _W, A, E, RULES, atoms, edges, evidence, log
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


# --------------------------------------------------------------------------------------------- whole tables
@query(derived.SQL["recall_responsibility"].replace(f"payload::json AS p FROM {A} WHERE json_valid(payload) AND type", f"p FROM {_P} WHERE type"))
def recall_responsibility_all(s, d):
    return derive.recall(atoms(s, d), "tally-1", ["agentic_trace", "action_outcome"])


@query(store.SQL["self_awareness_latest"].replace("json_extract_string(payload, '$.agent_id')", "p->>'$.agent_id'").replace(f"FROM {A} WHERE type = 'runtime_state' AND json_valid(payload)", f"FROM {_P} WHERE type = 'runtime_state'"))
def self_awareness_latest_all(s, d):
    return views.latest_state(atoms(s, d))


@query(store.SQL["self_awareness"].replace("json_extract_string(payload, '$.agent_id')", "p->>'$.agent_id'").replace(f"FROM {A} WHERE json_valid(payload) AND type", f"FROM {_P} WHERE type"))
def self_awareness_all(s, d):
    return views.self_awareness(atoms(s, d), _SELF)


@query(store.SQL["structured_dedupe"].replace("json_extract_string(payload, '$.retention.deduplication_key')", "p->>'$.retention.deduplication_key'").replace(f"FROM {A} WHERE json_valid(payload)", f"FROM {_P}"))
def structured_dedupe_all(s, d):
    a = quality.live(atoms(s, d)).select("id", upkeep.field("retention.deduplication_key").alias("k"), F.coalesce("utility", F.lit(0.0)).alias("u"), F.coalesce("updated_at", F.timestamp_micros(F.lit(0))).alias("at"))
    return quality.keep_best(a, "k", "id", "u", "at")


@query(store.SQL["contradictions"].replace(f"(SELECT *, payload::json AS p FROM {A} WHERE json_valid(payload))", _P))
def contradictions_all(s, d):
    return quality.contradictions(atoms(s, d)).drop("scope")


_SCOPE_TEXT = "list_sort(list_transform(json_keys(scope), lambda k: k || '=' || (scope->>k)))::varchar"


@query(f"WITH a AS (SELECT id, created_at, type, p->>'$.outcome' AS o, {_SCOPE_TEXT} AS sc FROM {_P}) SELECT id, kept FROM (SELECT id, first_value(id) OVER (PARTITION BY type, o, sc ORDER BY created_at NULLS FIRST, id) AS kept FROM a) WHERE id <> kept")
def outcome_dedupe(s, d):
    """Exact duplicates of records of which only type, outcome and scope are told."""
    a = atoms(s, d).dropDuplicates(["id"])
    return quality.exact_duplicates(a.withColumn("payload", F.to_json(F.struct(upkeep.field("outcome").alias("outcome")))))


@query("SELECT DISTINCT id, (scope->>'$.tenant') IS NULL OR (scope->>'$.tenant') IN ('tenant-2', 'global') AS visible FROM atoms")
def maintenance_visible(s, d):
    return atoms(s, d).select("id", scopes.maintenance_scope_visible(scopes.scope_map(), {"tenant": "tenant-2", "team": "x"}).alias("visible")).distinct()


@query(f"""
WITH x AS (SELECT DISTINCT e.edge_id, e.scope::json AS a, b.scope::json AS b FROM {E} e JOIN (SELECT DISTINCT ON (id) * FROM atoms) b ON b.id = e.source_ref WHERE json_valid(e.scope) AND json_valid(b.scope))
SELECT edge_id, len(list_filter(json_keys(a), lambda k: (a->>k) = (b->>k)))::int AS shared, len(list_filter(json_keys(a), lambda k: (a->>k) = (b->>k))) = len(json_keys(a)) AS applies FROM x""")
def scope_agreement(s, d):
    e = graph.live_edges(edges(s, d)).select("edge_id", "source_ref", scopes.scope_map().alias("a"), F.try_parse_json("scope").isNotNull().alias("ok")).where("ok")
    a = atoms(s, d).where(F.try_parse_json("scope").isNotNull()).dropDuplicates(["id"]).select(F.col("id").alias("source_ref"), scopes.scope_map().alias("b"))
    return e.join(a, "source_ref").select("edge_id", F.size(scopes.common_scope(F.col("a"), F.col("b"))).alias("shared"), scopes.scope_applies(F.col("a"), F.col("b")).alias("applies"))


@query("SELECT DISTINCT id, CASE WHEN coalesce((scope->>'$.tenant') = 'tenant-0', false) THEN coalesce(len(evidence_refs), -1) ELSE 0 END::int AS refs FROM atoms")
def evidence_redacted(s, d):
    mine = F.coalesce(scopes.scope_map()["tenant"] == "tenant-0", F.lit(False))
    return atoms(s, d).select("id", F.coalesce(F.size(scopes.redacted(F.col("evidence_refs"), mine)), F.lit(-1)).alias("refs")).distinct()


@query(f"SELECT DISTINCT id, ref FROM (SELECT id, unnest(p->>'$.participants[*]') AS ref FROM {_P}) WHERE trim(ref) <> ''")
def participant_refs(s, d):
    return quality.live(atoms(s, d)).select("id", F.explode(derive.structured_refs(upkeep.field("participants"))).alias("ref")).distinct()


@query(store.SQL["chain_gaps"].replace("FROM event_journal_entry)", "FROM event_journal_entry WHERE result_status = 'accepted')"))
def chain_problems_accepted(s, d):
    return journal.chain_problems(log(s, d).where("result_status = 'accepted'"))


@query("SELECT evidence_id, arg_min(checksum, (coalesce(captured_at, TIMESTAMP '1970-01-01'), checksum)) AS checksum FROM evidence WHERE evidence_id IS NOT NULL GROUP BY 1")
def evidence_first(s, d):
    return commands.first_evidence(evidence(s, d)).select("evidence_id", "checksum")


@query(f"SELECT edge_id, round({_W}::double * least(1.25, greatest(0.35, 1 + 0.03 * version - 0.08 * (coalesce(health_status = 'low_utility', false))::int * 5)), 6) AS weight FROM {E}")
def learned_weights(s, d):
    corrected = F.when(F.col("health_status") == "low_utility", 5).otherwise(0)
    return graph.live_edges(edges(s, d)).select("edge_id", F.round(graph.relation_weight(F.col("relation")) * graph.learned_weight(F.col("version"), corrected), 6).alias("weight"))


@query("""
SELECT budget_name, unnest(['candidate_atoms', 'continuation_edges', 'mandatory_atom_expansions', 'mandatory_edges']) AS allowance,
  unnest([greatest(32, b // 32), greatest(4, b // 512), greatest(8, b // 256), greatest(16, b // 128)]) AS n FROM (SELECT budget_name, capacity_tokens * 4 AS b FROM token_budgets)""")
def work_budgets(s, d):
    return derive.work_budgets(table(s, d, "token_budgets").select("budget_name", (F.col("capacity_tokens") * 4).alias("bytes")))


@query(f"""
SELECT 'shape' AS finding, count(*) AS n FROM ({store.SQL["shape_violations_all"]}) UNION ALL SELECT 'cluster', count(*) FROM ({store.SQL["cluster_keys_all"]})
UNION ALL SELECT 'conflict', count(*) FROM ({store.SQL["contradictions"].replace(f"(SELECT *, payload::json AS p FROM {A} WHERE json_valid(payload))", _P)})""")
def advisory_findings(s, d):
    a = atoms(s, d)
    parts = {"shape": quality.shape_violations(a, RULES), "cluster": quality.clusters(quality.cluster_keys(a)), "conflict": quality.contradictions(a)}
    return derive.tally(parts)


# ------------------------------------------------------------------------------------------------- frames
_LEX = """
raw AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(nullif(p->>'$.claim', ''), nullif(p->>'$.name', ''), nullif(p->>'$.description', ''), nullif(p->>'$.summary', ''), payload)), '[a-z0-9_]+')) AS w FROM """ + _P + """),
parts0 AS (SELECT id, w FROM raw UNION ALL SELECT id, unnest(string_split(w, '_')) FROM raw),
idx AS (SELECT DISTINCT id, w AS token FROM parts0 WHERE length(w) > 1 AND w NOT IN (""" + store._STOP + """) AND NOT regexp_matches(w, '""" + store.text.REFERENCE_TOKEN + """') AND NOT regexp_matches(w, '^[0-9a-f]{12,}$') AND NOT regexp_matches(w, '^v\\d+$')),
n AS (SELECT count(DISTINCT id) AS n FROM idx), f AS (SELECT token, count(*) AS df FROM idx GROUP BY 1),
z AS (SELECT id AS ref FROM (SELECT id, sum(ln((n + 1) / (df + 1)) + 1) AS s FROM idx JOIN f USING (token), n WHERE token IN ('greenhouse', 'quota', 'ratified') GROUP BY 1) ORDER BY round(s, 9) DESC, id LIMIT 32)"""
_names = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _frame_sql(mandatory, supporting, unit: str) -> str:
    return f"""
WITH RECURSIVE {_LEX},
must AS (SELECT source_ref AS a, target_ref AS b FROM {E} WHERE relation IN ({_names(mandatory)})), m2 AS (SELECT a, b FROM must UNION SELECT b, a FROM must),
sup AS (SELECT source_ref AS a, target_ref AS b FROM {E} WHERE relation IN ({_names(supporting)})), s2 AS (SELECT a, b FROM sup UNION SELECT b, a FROM sup),
h1 AS (SELECT DISTINCT b AS ref FROM m2 WHERE a IN (SELECT ref FROM z) AND b NOT IN (SELECT ref FROM z)),
h2 AS (SELECT DISTINCT b AS ref FROM m2 WHERE a IN (SELECT ref FROM h1) AND b NOT IN (SELECT ref FROM z) AND b NOT IN (SELECT ref FROM h1)),
c0 AS (SELECT ref, 0 AS hop, 'seed' AS kind FROM z UNION ALL SELECT ref, 1, 'mandatory' FROM h1 UNION ALL SELECT ref, 2, 'mandatory' FROM h2),
c AS (SELECT * FROM c0 UNION ALL SELECT DISTINCT b, 1, 'supporting' FROM s2 WHERE a IN (SELECT ref FROM c0) AND b NOT IN (SELECT ref FROM c0)),
inn AS (SELECT DISTINCT source_ref AS a, target_ref AS b, relation FROM {E} WHERE relation IN ({_names([*mandatory, *supporting])}) AND source_ref IN (SELECT ref FROM c) AND target_ref IN (SELECT ref FROM c)),
adj AS (SELECT a, b FROM inn UNION SELECT b, a FROM inn), r AS (SELECT ref, ref AS o FROM c UNION SELECT r.ref, adj.b FROM r JOIN adj ON r.o = adj.a),
k AS (SELECT ref, min(o) AS component FROM r GROUP BY 1),
t AS (SELECT component, list_distinct(list(type)) AS ty FROM k LEFT JOIN (SELECT DISTINCT id, type FROM {A}) ON id = ref GROUP BY 1),
l AS (SELECT component, list_distinct(list(relation)) AS rl FROM inn JOIN k ON k.ref = a GROUP BY 1),
u AS (SELECT component, {unit} AS unit FROM t LEFT JOIN l USING (component))
SELECT component, c.ref, c.hop, c.kind, unit FROM c JOIN k ON k.ref = c.ref JOIN u USING (component)"""


_UNIT = """CASE WHEN list_contains(rl, 'rel:contradicts') THEN 'conflict_set' WHEN list_has_any(rl, ['rel:supersedes', 'rel:decided']) THEN 'decision_chain' WHEN list_contains(ty, 'commitment') OR list_contains(rl, 'rel:made_commitment') THEN 'commitment_history'
  WHEN list_contains(ty, 'episode') THEN 'episode' WHEN list_contains(rl, 'rel:corrected_by') OR list_contains(ty, 'action_outcome') THEN 'failure_correction' WHEN list_has_any(ty, ['goal', 'policy', 'runtime_state']) THEN 'current_state' ELSE 'related_memory' END"""


@query(_frame_sql(lookup.MANDATORY, lookup.SUPPORTING, _UNIT))
def frame_units(s, d):
    return derive.frame(atoms(s, d), edges(s, d), ["greenhouse", "quota", "ratified"], list(lookup.MANDATORY), list(lookup.SUPPORTING), typed=True)


# reading_frame is the same over few relations and with units typed by relations alone
SQL["reading_frame"] = _frame_sql(["rel:supersedes", "rel:contradicts"], ["rel:supports", "rel:derived_from"], "CASE WHEN list_contains(rl, 'rel:contradicts') THEN 'conflict_set' WHEN list_contains(rl, 'rel:supersedes') THEN 'decision_chain' WHEN list_contains(rl, 'rel:corrected_by') THEN 'failure_correction' ELSE 'related' END")


# ----------------------------------------------------------------------------------------------- commands
_HALF = "(SELECT * FROM event_journal_entry WHERE graph_version <= (SELECT max(graph_version) // 2 FROM event_journal_entry))"


@query(f"""
WITH half AS {_HALF}, st AS ({problems.SQL["p1_found"].replace("event_journal_entry", _HALF)}),
led AS (SELECT actor, idempotency_key, min(payload_digest) AS dg FROM half WHERE idempotency_key IS NOT NULL GROUP BY ALL),
tb AS (SELECT payload::json->>'$.tombstone.target_ref' AS t, arg_max(payload::json->>'$.tombstone.recreation_policy', graph_version) AS policy FROM half WHERE result_status = 'accepted' AND json_extract_string(payload, '$.tombstone.target_ref') IS NOT NULL GROUP BY 1),
c0 AS (SELECT DISTINCT ON (event_id) event_id AS command_id, graph_version AS pos, actor, idempotency_key, target_refs[1] AS t, payload_digest, expected_versions,
  CASE WHEN json_exists(payload, '$.atom') THEN 'create' WHEN json_exists(payload, '$.after') THEN 'change' WHEN json_exists(payload, '$.tombstone') THEN 'remove' END AS kind
  FROM event_journal_entry WHERE graph_version > (SELECT max(graph_version) // 2 FROM event_journal_entry) ORDER BY event_id, graph_version),
c AS (SELECT *, TRY_CAST(expected_versions[t] AS bigint) AS x, first_value(command_id) OVER w AS f_id, first_value(payload_digest) OVER w AS f_dg FROM c0 WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY actor, idempotency_key ORDER BY pos, command_id)),
j AS (SELECT c.*, st.version AS now, led.dg, tb.policy FROM c LEFT JOIN st ON st.atom_id = c.t LEFT JOIN led ON led.actor = c.actor AND led.idempotency_key = c.idempotency_key LEFT JOIN tb ON tb.t = c.t),
r AS (SELECT *, coalesce(dg, CASE WHEN idempotency_key IS NOT NULL AND f_id <> command_id THEN f_dg END) AS known FROM j),
q AS (SELECT *, CASE WHEN known IS NOT NULL AND known = payload_digest THEN 'repeated' WHEN known IS NOT NULL THEN 'idempotency_conflict' WHEN kind <> 'create' AND now IS NULL THEN 'unknown_target'
  WHEN kind = 'create' AND now IS NULL AND policy <> 'allow_recreate' THEN 'blocked' WHEN kind = 'create' AND now IS NOT NULL THEN 'exists' WHEN x <> coalesce(now, 0) THEN 'version_conflict' END AS reason FROM r),
w AS (SELECT t, arg_min(command_id, (pos, command_id)) AS winner FROM q WHERE reason IS NULL GROUP BY 1)
SELECT command_id, coalesce(reason, CASE WHEN winner <> command_id THEN 'version_conflict' END, 'accepted') AS outcome FROM q LEFT JOIN w ON w.t = q.t""")
def command_outcomes(s, d):
    """The younger half of the journal as one batch of commands against the state the older half leaves."""
    j = log(s, d)
    middle = (j.agg(F.max("graph_version")).first()[0] or 0) // 2
    old, new = j.where(F.col("graph_version") <= middle), j.where(F.col("graph_version") > middle)
    ok = old.where("result_status = 'accepted'")
    g = lambda f: F.get_json_object("payload", f"$.{f}")
    tombs = ok.select(g("tombstone.target_ref").alias("target_ref"), g("tombstone.recreation_policy").alias("recreation_policy"), F.timestamp_micros("graph_version").alias("created_at")).where("target_ref is not null")
    state = changes.apply_changes(old).select(F.col("atom_id").alias("key"), "version")
    kind = F.when(g("atom").isNotNull(), "create").when(g("after").isNotNull(), "change").when(g("tombstone").isNotNull(), "remove")
    c = new.select("event_id", F.struct("graph_version", "actor", "idempotency_key", kind.alias("kind"), F.get("target_refs", F.lit(0)).alias("target"), F.try_element_at("expected_versions", F.get("target_refs", F.lit(0))).alias("expected"), "payload_digest").alias("r"))
    c = c.groupBy(F.col("event_id").alias("command_id")).agg(F.min("r").alias("r")).select("command_id", F.col("r.graph_version").alias("position"), "r.actor", "r.idempotency_key", "r.kind", "r.target", "r.expected", "r.payload_digest").where("kind is not null")
    done, rejected = commands.compile_commands(c, old.select("actor", "idempotency_key", "payload_digest"), state, tombs)
    return done.select("command_id", F.lit("accepted").alias("outcome")).unionByName(rejected.select("command_id", F.col("reason").alias("outcome")))


@query("""
WITH RECURSIVE e AS (SELECT event_id, payload_digest, row_number() OVER (ORDER BY g, event_id) AS v FROM (SELECT event_id, min(graph_version) AS g, min(payload_digest) AS payload_digest FROM event_journal_entry WHERE event_id IS NOT NULL GROUP BY 1)),
c AS (SELECT 0::bigint AS v, ''::varchar AS event_id, ''::varchar AS previous_event_hash, 'genesis'::varchar AS checksum
  UNION ALL SELECT e.v, e.event_id, c.checksum, sha256(c.checksum || '|' || e.v || '|' || e.event_id || '|' || e.payload_digest) FROM c JOIN e ON e.v = c.v + 1)
SELECT event_id, v AS graph_version, previous_event_hash, checksum FROM c WHERE v > 0""")
def append_chain(s, d):
    e = log(s, d).where("event_id is not null").groupBy("event_id").agg(F.min("graph_version").alias("position"), F.min("payload_digest").alias("payload_digest"))
    return journal.append(e, 0, "genesis")


# ----------------------------------------------------------------------------------------- vectors and text
@query(f"""
WITH {store._INDEX}, top AS (SELECT token FROM idx GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 300), i AS (SELECT * FROM idx WHERE token IN (SELECT token FROM top)), n AS (SELECT count(DISTINCT doc_id) AS n FROM i),
w AS (SELECT doc_id, token, ln((n + 1) / (df + 1)) + 1 AS w FROM i JOIN (SELECT token, count(*) AS df FROM i GROUP BY 1) USING (token), n)
SELECT x.token AS a, y.token AS b, round(sum(x.w * y.w), 6) AS weight FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.token <= y.token GROUP BY ALL""")
def latent_gram(s, d):
    return latent.cooccurrence(text_index.postings(store.docs(s, d), "doc_id", "text"), "doc_id").withColumn("weight", F.round("weight", 6))


# every retained token has a vector of all components: the Gram matrix of the corpus has full rank
SQL["latent_token_vectors"] = f"WITH {store._INDEX} SELECT token, 32 AS components FROM idx GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 300"


@query("""
WITH v AS (SELECT token, TRY_CAST(vector_json AS DOUBLE[]) AS x FROM (SELECT DISTINCT token, dimensions, vector_json FROM token_latent_vectors t WHERE graph_version = (SELECT max(graph_version) FROM token_latent_vectors u WHERE u.token = t.token)) WHERE dimensions = 64),
w AS (SELECT token, x FROM v WHERE len(x) = 64 AND len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND list_max(list_transform(x, lambda e: abs(e))) > 0),
q AS (SELECT min(token) AS token FROM w)
SELECT w.token, round(list_cosine_similarity(w.x, (SELECT x FROM w JOIN q USING (token))), 4) AS sim FROM w, q WHERE w.token <> q.token AND list_cosine_similarity(w.x, (SELECT x FROM w JOIN q USING (token))) >= 0.22 ORDER BY list_cosine_similarity(w.x, (SELECT x FROM w JOIN q USING (token))) DESC, w.token LIMIT 64""")
def latent_candidates(s, d):
    v = latent.usable(table(s, d, "token_latent_vectors"), 64)
    cue = v.orderBy("token").limit(1).select("vec").first()
    return latent.candidates(v, [float(x) for x in cue.vec] if cue else [0.0] * 64, 64, 0.22).withColumn("sim", F.round("sim", 4))


@query(f"""
WITH e AS {E}, a AS {A},
x AS (SELECT 'isolate' AS step, edge_id AS ref FROM e WHERE source_ref IN (SELECT id FROM a WHERE lifecycle_state = 'proposed') OR target_ref IN (SELECT id FROM a WHERE lifecycle_state = 'proposed')
  UNION ALL SELECT 'prune', edge_id FROM ({derived.SQL["edges_to_retire"]})
  UNION ALL SELECT 'archive_structured', id FROM ({store.SQL["structured_dedupe"].replace("json_extract_string(payload, '$.retention.deduplication_key')", "p->>'$.retention.deduplication_key'").replace(f"FROM {A} WHERE json_valid(payload)", f"FROM {_P}")}))
SELECT DISTINCT step, ref FROM x""")
def steward_plan(s, d):
    return upkeep.steward_plan(atoms(s, d), edges(s, d))


@query(f"SELECT source_ref, target_ref, relation, row_number() OVER (ORDER BY source_ref, target_ref, relation)::int AS place FROM ({derived.SQL['processor_proposals']}) ORDER BY 4 LIMIT 200")
def proposal_order(s, d):
    return upkeep.proposal_order(derived.QUERIES["processor_proposals"](s, d), 200)


# ---------------------------------------------------------------------------------------------- provenance
_WAYS = f"""
raw AS (SELECT source_ref AS r, target_ref AS up FROM {E} WHERE relation = 'rel:derived_from'
  UNION SELECT id, x FROM (SELECT id, unnest(CASE WHEN json_type(payload, '$.source_refs') = 'ARRAY' THEN payload->>'$.source_refs[*]' ELSE [] END) AS x FROM atoms WHERE json_valid(payload)) WHERE x IN (SELECT id FROM atoms)),
up AS (SELECT DISTINCT r, up FROM raw WHERE r IS NOT NULL AND up IS NOT NULL),
w AS (SELECT DISTINCT id AS ref, [id] AS path, false AS cyc FROM {A}
  UNION ALL SELECT w.ref, list_append(w.path, u.up), list_contains(w.path, u.up) FROM w JOIN up u ON u.r = w.path[-1] WHERE NOT w.cyc AND (list_contains(w.path, u.up) OR u.up IN (SELECT id FROM atoms))),
ends AS (SELECT ref, path, path[-1] AS last FROM w WHERE NOT cyc AND path[-1] NOT IN (SELECT r FROM up)),
rec AS (SELECT id, type, list_filter(evidence_refs, lambda x: x IS NOT NULL) AS refs FROM (SELECT DISTINCT ON (id) * FROM atoms)),
ev AS (SELECT evidence_id, coalesce(nullif(p->>'$.independence_group', ''), nullif(source_ref, '')) AS g, coalesce(nullif(p->>'$.testimony_family', ''), nullif(source_type, '')) AS f FROM (SELECT DISTINCT ON (evidence_id) *, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM evidence)),
led AS (SELECT ref, path, last, type, unnest(CASE WHEN coalesce(len(refs), 0) = 0 THEN [NULL] ELSE refs END) AS ev FROM ends JOIN rec ON rec.id = last),
found AS (SELECT ref, CASE WHEN ev IS NULL THEN path ELSE list_append(path, ev) END AS path, coalesce(ev, last) AS root_ref, CASE WHEN ev IS NULL THEN 'atom' ELSE 'evidence' END AS kind,
  coalesce(CASE WHEN ev IS NOT NULL THEN coalesce(g, ev) END, last) AS independence_group, coalesce(CASE WHEN ev IS NOT NULL THEN f ELSE nullif(type, '') END, 'unknown') AS testimony_family FROM led LEFT JOIN ev e ON e.evidence_id = led.ev)"""
SQL["provenance_roots"] = f"WITH RECURSIVE {_WAYS} SELECT DISTINCT ref, root_ref, kind, independence_group, testimony_family FROM found"
SQL["provenance_summary"] = f"""WITH RECURSIVE {_WAYS},
per AS (SELECT ref, count(DISTINCT root_ref) AS roots, count(DISTINCT independence_group) AS groups, count(DISTINCT testimony_family) AS families, max(len(path) - 1)::int AS depth FROM found GROUP BY 1),
loops AS (SELECT ref, bool_or(path[-1] = ref) AS own FROM w WHERE cyc GROUP BY 1)
SELECT coalesce(per.ref, loops.ref) AS ref, coalesce(roots, 0) AS roots, coalesce(groups, 0) AS independence_groups, coalesce(families, 0) AS testimony_families, coalesce(depth, 0) AS ancestry_depth, own IS NOT NULL AS circular_support, coalesce(own, false) AS self_descendant_support FROM per FULL JOIN loops ON loops.ref = per.ref"""
SQL["provenance_common_ancestors"] = f"WITH RECURSIVE {_WAYS} SELECT ref, atom_ref, count(*) AS root_path_count FROM (SELECT ref, unnest(list_distinct(path[2:len(path) - 1])) AS atom_ref FROM found) GROUP BY ALL HAVING count(*) > 1"
SQL["reference_repairs"] = f"""
WITH rows AS (SELECT 'atom' AS record_kind, id AS record_ref, coalesce(evidence_refs, []) AS refs, CASE WHEN json_type(p, '$.source_refs') = 'ARRAY' THEN p->>'$.source_refs[*]' ELSE [] END AS had, CASE WHEN json_type(p, '$.unresolved_source_refs') = 'ARRAY' THEN p->>'$.unresolved_source_refs[*]' ELSE [] END AS open FROM {_P} WHERE lifecycle_state IN ('active', 'proposed')
  UNION ALL SELECT 'edge', edge_id, coalesce(evidence_refs, []), [], [] FROM (SELECT DISTINCT ON (edge_id) * FROM edges WHERE NOT coalesce(deleted, false) AND coalesce(lifecycle_state, 'active') = 'active')),
x AS (SELECT record_kind, record_ref, trim(unnest(refs)) AS ref, generate_subscripts(refs, 1) AS pos FROM rows),
y AS (SELECT record_kind, record_ref, ref, min(pos) AS pos FROM x WHERE ref <> '' GROUP BY ALL),
z AS (SELECT record_kind, record_ref, coalesce(list(ref ORDER BY pos) FILTER (ref IN (SELECT evidence_id FROM evidence)), []) AS kept, coalesce(list(ref ORDER BY pos) FILTER (ref NOT IN (SELECT evidence_id FROM evidence WHERE evidence_id IS NOT NULL) AND ref IN (SELECT id FROM atoms)), []) AS moved,
  coalesce(list(ref ORDER BY pos) FILTER (ref NOT IN (SELECT evidence_id FROM evidence WHERE evidence_id IS NOT NULL) AND ref NOT IN (SELECT id FROM atoms WHERE id IS NOT NULL)), []) AS lost FROM y GROUP BY ALL),
r AS (SELECT rows.*, coalesce(kept, []) AS kept, coalesce(moved, []) AS moved, coalesce(lost, []) AS lost FROM rows LEFT JOIN z USING (record_kind, record_ref))
SELECT record_kind, record_ref, kept AS retained_evidence_refs, moved AS moved_source_refs, lost AS moved_unresolved_refs, list_concat(had, moved) AS source_refs, list_concat(open, lost) AS unresolved_source_refs FROM r WHERE kept IS DISTINCT FROM refs"""
