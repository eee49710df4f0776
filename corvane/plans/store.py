"""Queries of the store's own operators over its tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids, scopes, text, times, vectors
from corvane.functions.records import confidence
from corvane.operators import graph, journal, quality, retrieval, scans, text_index, views
from corvane.sources import table, tables

NOW = "2026-07-01 00:00:00"
ASKED = {"tenant": "tenant-1"}
READER = {"tenant": "tenant-2", "workspace": "ws-head-002"}
CUES = ["greenhouse", "quarterly archive", "budget"]
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(name):
    return lambda s, d: table(s, d, name)


atoms, edges, evidence, events_t, docs, messages, log = map(t, ("atoms", "edges", "evidence", "events", "documents", "interaction_event", "event_journal_entry"))

A = "(SELECT * FROM (SELECT DISTINCT ON (id) * FROM atoms) WHERE NOT coalesce(deleted, false))"
E = "(SELECT DISTINCT ON (edge_id) * FROM edges WHERE NOT coalesce(deleted, false) AND lifecycle_state = 'active' AND source_ref IS NOT NULL AND target_ref IS NOT NULL)"


# ------------------------------------------------------------------------------------------------ scans
@query("SELECT DISTINCT id, type, lifecycle_state, updated_at FROM atoms WHERE NOT deleted AND type IN ('belief', 'goal') AND lifecycle_state IN ('active', 'proposed') AND NOT coalesce(health_status IN ('stale', 'contradicted'), false)")
def scan_filtered(s, d):
    return scans.filtered(atoms(s, d), types=["belief", "goal"], lifecycle=["active", "proposed"], without_health=["stale", "contradicted"]).select("id", "type", "lifecycle_state", "updated_at").distinct()


@query("SELECT id, lifecycle_state FROM (SELECT DISTINCT id, lifecycle_state, updated_at FROM atoms) ORDER BY CASE lifecycle_state WHEN 'active' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END, updated_at DESC NULLS LAST, id LIMIT 512")
def scan_hot(s, d):
    return scans.newest(atoms(s, d).select("id", "lifecycle_state", "updated_at").distinct(), 512).select("id", "lifecycle_state")


@query("SELECT DISTINCT id FROM atoms WHERE NOT deleted AND json_valid(payload) AND json_extract_string(payload, '$.status') IN ('open', 'waiting') AND json_extract_string(payload, '$.owner') IN ('keeper-2', 'scribe-6', 'weaver-3')")
def payload_filter_json(s, d):
    return scans.filtered(atoms(s, d), payload={"status": ["open", "waiting"], "owner": ["keeper-2", "scribe-6", "weaver-3"]}).select("id").distinct()


@query("SELECT DISTINCT id FROM atoms WHERE NOT deleted AND id IN (SELECT source_ref FROM edges WHERE relation = 'rel:supports')")
def scan_by_ids(s, d):
    return scans.filtered(atoms(s, d), ids=edges(s, d).where("relation = 'rel:supports'").select("source_ref")).select("id").distinct()


@query("WITH r AS (SELECT DISTINCT unnest(evidence_refs) AS ref FROM atoms UNION SELECT target_ref FROM edges) SELECT ref, CASE WHEN e AND a THEN 'ambiguous' WHEN e THEN 'evidence' WHEN a THEN 'atom' ELSE 'unknown' END AS kind FROM (SELECT ref, ref IN (SELECT evidence_id FROM evidence) AS e, ref IN (SELECT id FROM atoms) AS a FROM r WHERE ref IS NOT NULL)")
def reference_classify(s, d):
    refs = atoms(s, d).select(F.explode("evidence_refs").alias("ref")).unionByName(edges(s, d).select(F.col("target_ref").alias("ref")))
    return scans.resolve(refs, atoms(s, d), evidence(s, d))


@query("""
SELECT id, CASE WHEN deleted THEN 'deleted' WHEN NOT coalesce(lifecycle_state = 'active', false) THEN 'lifecycle'
  WHEN NOT (coalesce(json_extract_string(scope, '$.tenant') IN ('tenant-1', 'global'), json_extract_string(scope, '$.tenant') IS NULL)
    AND coalesce(json_extract_string(scope, '$.workspace') = 'global', json_extract_string(scope, '$.workspace') IS NULL)) THEN 'scope'
  WHEN health_status = 'contradicted' THEN 'contradicted' WHEN health_status IN ('confounding', 'low_utility', 'merged', 'orphaned', 'stale') THEN 'low_health' END AS reason
FROM (SELECT DISTINCT id, deleted, lifecycle_state, scope, health_status FROM atoms)""")
def scope_access_reasons(s, d):
    return scans.visibility_reasons(atoms(s, d).select("id", "deleted", "lifecycle_state", "scope", "health_status").distinct(), ASKED)


@query("SELECT DISTINCT edge_id, source_ref, target_ref FROM edges WHERE NOT deleted AND relation IN ('rel:supports', 'rel:uses') AND (source_ref IN (SELECT id FROM seed_atoms) OR target_ref IN (SELECT id FROM seed_atoms))")
def edges_for_refs(s, d):
    return scans.edges_of(edges(s, d), table(s, d, "seed_atoms").select(F.col("id").alias("ref")), ["rel:supports", "rel:uses"]).select("edge_id", "source_ref", "target_ref")


@query("SELECT DISTINCT graph_version, event_id, event_type FROM event_journal_entry WHERE graph_version > 100 ORDER BY graph_version LIMIT 50")
def journal_tail(s, d):
    return scans.tail(log(s, d), 100, 50).select("graph_version", "event_id", "event_type")


@query("WITH p AS (SELECT *, row_number() OVER (ORDER BY graph_version) AS n FROM (SELECT DISTINCT graph_version, event_id FROM event_journal_entry WHERE graph_version > 200) LIMIT 26) SELECT graph_version, event_id, (SELECT count(*) FROM p) > 25 AS has_more FROM p WHERE n <= 25")
def cursor_page(s, d):
    rows = log(s, d).select("graph_version", "event_id").distinct()
    return scans.page(rows, "graph_version", 200, 25)


@query("WITH x AS (SELECT DISTINCT source_ref, target_ref FROM edges WHERE NOT deleted AND lifecycle_state = 'active' AND relation = 'rel:supersedes'), a AS (SELECT DISTINCT id, lifecycle_state AS l FROM atoms WHERE NOT deleted) SELECT target_ref AS ref, string_agg(source_ref, ',' ORDER BY source_ref) AS superseded_by FROM x WHERE source_ref IN (SELECT id FROM a WHERE l = 'active') AND target_ref IN (SELECT id FROM a WHERE l IN ('active', 'superseded')) GROUP BY 1")
def supersession_map(s, d):
    return scans.supersession(edges(s, d), atoms(s, d))


@query("SELECT DISTINCT id FROM atoms WHERE NOT deleted AND id NOT IN (SELECT source_ref FROM edges WHERE NOT deleted AND source_ref IS NOT NULL UNION SELECT target_ref FROM edges WHERE NOT deleted AND target_ref IS NOT NULL)")
def isolated_atoms_anti(s, d):
    return scans.isolated(atoms(s, d), edges(s, d))


@query("SELECT id, evidence_refs_n FROM (SELECT DISTINCT id, coalesce(len(list_distinct(evidence_refs)), 0) AS evidence_refs_n, tenant FROM (SELECT *, json_extract_string(scope, '$.tenant') AS tenant FROM atoms)) WHERE tenant IS NULL OR tenant <> 'tenant-2'")
def maintenance_scope(s, d):
    a = atoms(s, d).where(scopes.maintenance_scope_visible(scopes.scope_map(), {"tenant": "!", "team": "x"}) | ~F.coalesce(scopes.scope_map()["tenant"] == "tenant-2", F.lit(False)))
    return a.select("id", F.coalesce(F.size(F.filter(F.array_distinct("evidence_refs"), lambda x: x.isNotNull())), F.lit(0)).alias("evidence_refs_n")).distinct()


# ----------------------------------------------------------------------------------------- text and vectors
@query("SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) GROUP BY 1")
def token_df(s, d):
    return text_index.frequencies(text_index.postings(docs(s, d), "doc_id", "text", content_only=False), "doc_id")


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_INDEX = f"""
raw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents),
parts AS (SELECT doc_id, w FROM raw UNION ALL SELECT doc_id, unnest(string_split(w, '_')) FROM raw),
idx AS (SELECT DISTINCT doc_id, w AS token FROM parts WHERE length(w) > 1 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '{text.REFERENCE_TOKEN.replace('{', '{')}') AND NOT regexp_matches(w, '^[0-9a-f]{{12,}}$') AND NOT regexp_matches(w, '^v\\d+$'))"""


@query(f"WITH {_INDEX}, n AS (SELECT count(DISTINCT doc_id) AS n FROM idx), f AS (SELECT token, count(*) AS df FROM idx GROUP BY 1), x AS (SELECT doc_id, sum(ln((n + 1) / (df + 1)) + 1) AS score FROM idx JOIN f USING (token), n WHERE token IN ('greenhouse', 'ratified', 'quarry') GROUP BY 1) SELECT doc_id, round(score, 6) AS score FROM x ORDER BY round(score, 9) DESC, doc_id LIMIT 100")
def lexical_topk(s, d):
    return text_index.best_matches(docs(s, d), "doc_id", "text", ["greenhouse", "ratified", "quarry"], 100).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_INDEX}, top AS (SELECT token FROM idx GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 50) SELECT doc_id, token FROM idx WHERE token IN (SELECT token FROM top)")
def token_index_top_terms(s, d):
    return text_index.top_terms(text_index.postings(docs(s, d), "doc_id", "text"), "doc_id", 50).select("doc_id", "token")


@query("SELECT doc_id, rtrim(substr(x, 1, 79)) || CASE WHEN length(x) > 80 THEN '…' ELSE substr(x, 80, 1) END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS x FROM documents WHERE text IS NOT NULL AND lang = 'en') WHERE length(x) > 80")
def truncated_text(s, d):
    x = docs(s, d).where("text is not null and lang = 'en'").withColumn("long", F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 80).where("long")
    return x.select("doc_id", text.squeeze(F.col("text"), 80).alias("short"))


# White space of any script, as the reference's split() takes it.
_BLANK = "[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(SQL["truncated_text"].replace(" AND lang = 'en'", "").replace("[ \\t\\n\\r\\f\\v]+", _BLANK))
def truncated_text_all(s, d):
    x = docs(s, d).where("text is not null").select("doc_id", F.trim(F.regexp_replace("text", _BLANK, " ")).alias("text"))
    return x.where(F.length("text") > 80).select("doc_id", text.squeeze(F.col("text"), 80).alias("short"))


@query("SELECT gram, count(*) AS n FROM (SELECT unnest(list_concat(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3)), list_transform(range(1, length(f) - 2), lambda i: substr(f, i, 4)))) AS gram FROM (SELECT '^' || w || '$' AS f FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents WHERE lang = 'de') WHERE length(w) >= 3)) GROUP BY 1")
def char_ngrams(s, d):
    w = docs(s, d).where("lang = 'de'").select(F.explode(text.tokens(F.col("text"))).alias("w"))
    return w.select(F.explode(text.char_ngrams(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(SQL["char_ngrams"].replace(" WHERE lang = 'de'", ""))
def char_ngrams_all(s, d):
    w = docs(s, d).select(F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))  # each word is cut once
    return w.select(F.explode(text.char_ngrams(F.col("w"))).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


@query("""
WITH w AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM w GROUP BY 1), tot AS (SELECT count(DISTINCT doc_id) AS t FROM documents),
g AS (SELECT doc_id, gram, sum(n) AS n FROM (SELECT doc_id, n, unnest(list_concat(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)), list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4)))) AS gram FROM (SELECT doc_id, n, '^' || token || '$' AS x FROM w WHERE length(token) >= 3)) GROUP BY ALL),
v AS (SELECT doc_id, ('0x' || right(sha256('"' || token || '"'), 2))::int % 64 AS slot, (1 + ln(n)) * (ln((t + 1) / (df + 1)) + 1) AS x FROM w JOIN f USING (token), tot
  UNION ALL SELECT doc_id, ('0x' || right(sha256('"char:' || gram || '"'), 2))::int % 64, 0.35 * (1 + ln(n)) FROM g),
z AS (SELECT doc_id, slot, sum(x) AS x FROM v GROUP BY ALL)
SELECT doc_id, slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM z""")
def hash_slot_vectors(s, d):
    return vectors.encode(docs(s, d), "doc_id", "text").select("doc_id", "slot", F.round("weight", 6).alias("weight"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 1)), 6) AS sim FROM embeddings ORDER BY list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 1)) DESC, vec_id LIMIT 20")
def cosine_topk(s, d):
    e = table(s, d, "embeddings")
    cue = e.where("vec_id = 1").select("embedding").first()  # the cue is a parameter: one vector
    sim = vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in cue.embedding]))
    return e.select("vec_id", sim.alias("x")).orderBy(F.desc("x"), "vec_id").limit(20).select("vec_id", F.round("x", 6).alias("sim"))


@query("SELECT query_id, vec_id, round(sim, 6) AS sim FROM (SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE n <= 20")
def cosine_topk_all(s, d):
    e = table(s, d, "embeddings")
    return vectors.nearest_all(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 20).withColumn("sim", F.round("sim", 6))


# ---------------------------------------------------------------------------------------- ids and records
@query("SELECT DISTINCT id, sha256('{\"tenant\":\"' || json_extract_string(scope, '$.tenant') || '\",\"workspace\":\"' || json_extract_string(scope, '$.workspace') || '\"}') AS digest FROM atoms WHERE json_array_length(json_keys(scope)) = 2 AND json_exists(scope, '$.tenant') AND json_exists(scope, '$.workspace')")
def scope_digest(s, d):
    m = scopes.scope_map()
    return atoms(s, d).where((F.size(m) == 2) & F.map_contains_key(m, "tenant") & F.map_contains_key(m, "workspace")).select("id", ids.digest(ids.canonical_json(F.col("scope"))).alias("digest")).distinct()


@query("SELECT DISTINCT edge_id, 'edge_' || substr(sha256('[\"' || concat_ws('\",\"', source_ref, target_ref, relation) || '\"]'), 1, 20) AS stable FROM edges")
def edge_stable_id(s, d):
    return edges(s, d).select("edge_id", ids.stable_id("edge", ids.pair_list(F.col("source_ref"), F.col("target_ref"), F.col("relation"))).alias("stable")).distinct()


_CONF = "coalesce(confidence.score, CASE confidence.level WHEN 'low' THEN 0.2 WHEN 'low-medium' THEN 0.35 WHEN 'medium' THEN 0.5 WHEN 'medium-high' THEN 0.75 WHEN 'high' THEN 0.9 END, 0.5)"


@query(f"SELECT relation, least(floor({_CONF} * 5), 4)::int AS bucket, count(*) AS n FROM (SELECT DISTINCT ON (edge_id) * FROM edges) GROUP BY ALL")
def confidence_histogram(s, d):
    return quality.confidence_histogram(edges(s, d).dropDuplicates(["edge_id"]))


@query(f"SELECT id, round(coalesce(greatest(0, 1 - greatest(0, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(updated_at))::bigint) / 2592000.0), 0), 6) AS recency FROM (SELECT DISTINCT id, updated_at FROM atoms)")
def recency_score(s, d):
    return atoms(s, d).select("id", "updated_at").distinct().select("id", F.round(times.recency(F.col("updated_at"), NOW), 6).alias("recency"))


@query("SELECT id, coalesce(nullif(p->>'$.claim', ''), nullif(p->>'$.name', ''), nullif(p->>'$.description', ''), nullif(p->>'$.summary', ''), payload) AS text FROM (SELECT DISTINCT id, payload, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM atoms WHERE json_valid(payload))")
def rendered_text(s, d):
    return quality.rendered(atoms(s, d).where(F.try_parse_json("payload").isNotNull()))


@query(SQL["rendered_text"].replace(" FROM atoms WHERE json_valid(payload))", " FROM atoms)"))
def rendered_text_all(s, d):
    return quality.rendered(atoms(s, d))


# ----------------------------------------------------------------------------------- counts and integrity
@query("SELECT type, lifecycle_state, health_status, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM atoms) GROUP BY ALL")
def group_counts(s, d):
    return quality.counts_by(atoms(s, d).dropDuplicates(["id"]), "type", "lifecycle_state", "health_status")


@query("WITH r AS (SELECT unnest(evidence_refs) AS ref FROM atoms WHERE NOT deleted UNION ALL SELECT unnest(evidence_refs) FROM edges WHERE NOT deleted), j AS (SELECT ref IN (SELECT evidence_id FROM evidence) AS e, ref IN (SELECT id FROM atoms) AS a FROM r WHERE ref <> '') SELECT count(*) AS refs, count(*) FILTER (e) AS evidence, count(*) FILTER (NOT e AND a) AS record, count(*) FILTER (NOT e AND NOT a) AS nothing FROM j")
def integrity_summary(s, d):
    return quality.integrity_summary(atoms(s, d), edges(s, d), evidence(s, d))


@query(f"SELECT lifecycle_state, CASE WHEN x IS NULL THEN 'unknown' WHEN x < 1 THEN 'day' WHEN x < 7 THEN 'week' WHEN x < 30 THEN 'month' ELSE 'older' END AS age, count(*) AS n FROM (SELECT lifecycle_state, greatest(0, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(created_at))::bigint) / 86400.0 AS x FROM {A}) GROUP BY ALL")
def proposal_age_buckets(s, d):
    return quality.age_buckets(atoms(s, d), NOW)


@query(f"WITH r AS (SELECT DISTINCT id, unnest(evidence_refs) AS ref FROM {A}), e AS (SELECT DISTINCT ON (evidence_id) * FROM evidence) SELECT id, count(DISTINCT source_ref) AS sources, count(DISTINCT source_type) AS kinds FROM r JOIN e ON evidence_id = ref GROUP BY 1")
def evidence_diversity(s, d):
    return quality.evidence_diversity(atoms(s, d), evidence(s, d))


@query(f"WITH r AS (SELECT DISTINCT id, unnest(evidence_refs) AS ref FROM {A}), j AS (SELECT id, ref IN (SELECT evidence_id FROM evidence) AS e, ref IN (SELECT id FROM atoms) AS a FROM r WHERE ref <> '') SELECT id, count(*) FILTER (e) AS exact, count(*) FILTER (NOT e AND a) AS record, count(*) FILTER (NOT e AND NOT a) AS unresolved FROM j GROUP BY 1")
def ref_partition(s, d):
    return quality.partition_refs(atoms(s, d), evidence(s, d))


@query("SELECT actor, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY x), 1) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY x), 1) AS p95, round(avg(x), 1) AS mean FROM (SELECT DISTINCT actor, event_id, epoch_us(accepted_at) - epoch_us(occurred_at) AS x FROM event_journal_entry) GROUP BY 1")
def latency_percentiles(s, d):
    e = log(s, d).select("actor", "event_id", (F.unix_micros("accepted_at") - F.unix_micros("occurred_at")).alias("x")).distinct()
    return quality.percentiles(e, "actor", "x").select("actor", *[F.round(c, 1).alias(c) for c in ("p50", "p95", "mean")])


# ----------------------------------------------------------------------------------- duplicates and groups
@query("WITH v AS (SELECT DISTINCT doc_id, text, created_at FROM documents WHERE text IS NOT NULL) SELECT doc_id AS id, kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM v) WHERE doc_id <> kept")
def exact_dedupe(s, d):
    x = docs(s, d).where("text is not null").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("g"), (-F.col("doc_id")).alias("o"))
    return quality.keep_best(x, "g", "id", "o")


@query(f"WITH a AS (SELECT id, created_at, coalesce(type, '') || chr(1) || coalesce(payload, '') || chr(1) || coalesce(scope, '') AS k FROM {A} WHERE payload IS NULL OR NOT json_valid(payload)) SELECT id, kept FROM (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY created_at NULLS FIRST, id) AS kept FROM a) WHERE id <> kept")
def unparsable_dedupe(s, d):
    return quality.exact_duplicates(atoms(s, d))


@query(f"WITH g AS (SELECT id, json_extract_string(payload, '$.retention.deduplication_key') AS k, coalesce(utility, 0) AS u, coalesce(updated_at, TIMESTAMP '1970-01-01') AS t0 FROM {A} WHERE json_valid(payload)) SELECT id, kept FROM (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY u DESC, t0 DESC, id) AS kept FROM g WHERE k IS NOT NULL) WHERE id <> kept")
def structured_dedupe(s, d):
    a = quality.live(atoms(s, d)).select("id", F.get_json_object("payload", "$.retention.deduplication_key").alias("k"), F.coalesce("utility", F.lit(0.0)).alias("u"), F.coalesce("updated_at", F.timestamp_micros(F.lit(0))).alias("at"), "payload").where(F.try_parse_json("payload").isNotNull()).drop("payload")
    return quality.keep_best(a, "k", "id", "u", "at")


_CLUSTER = f"""
WITH k AS (SELECT id, coalesce(CASE WHEN coalesce(p->>'$.subject', '') <> '' AND coalesce(p->>'$.predicate', '') <> '' THEN lower(p->>'$.subject') || '|' || lower(p->>'$.predicate') END, lower(nullif(p->>'$.name', '')), array_to_string(regexp_extract_all(lower(payload), '[a-z0-9_]+')[:8], ' '), '') AS cluster
  FROM (SELECT *, payload::json AS p FROM {A} WHERE json_valid(payload)))"""


@query(_CLUSTER + " SELECT cluster, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1 HAVING count(*) >= 2")
def cluster_keys(s, d):
    return quality.clusters(quality.cluster_keys(atoms(s, d).where(F.try_parse_json("payload").isNotNull())))


@query(SQL["cluster_keys"].replace("payload::json AS p", "CASE WHEN json_valid(payload) THEN payload::json END AS p").replace(" WHERE json_valid(payload)))", "))"))
def cluster_keys_all(s, d):
    return quality.clusters(quality.cluster_keys(atoms(s, d)))


@query(f"""
WITH g AS (SELECT id, type, scope, regexp_replace(lower(trim(nullif(p->>'$.subject', ''))), '[\\s_-]+', '_', 'g') AS subject, regexp_replace(lower(trim(nullif(p->>'$.predicate', ''))), '[\\s_-]+', '_', 'g') AS predicate, nullif(p->>'$.value', '') AS v,
  coalesce('' || (scope->>'$.tenant') || (scope->>'$.workspace'), '') AS sc FROM (SELECT *, payload::json AS p FROM {A} WHERE json_valid(payload)))
SELECT type, subject, predicate, count(DISTINCT v) AS n_values, count(*) AS n_records FROM g WHERE subject IS NOT NULL AND predicate IS NOT NULL AND v IS NOT NULL GROUP BY type, sc, subject, predicate HAVING count(DISTINCT v) > 1""")
def contradictions(s, d):
    return quality.contradictions(atoms(s, d).where(F.try_parse_json("payload").isNotNull())).drop("scope")


@query(f"SELECT cohort, count(*) AS n, arg_min(id, (-u, id)) AS best FROM (SELECT id, concat_ws('/', type, json_extract_string(scope, '$.tenant')) AS cohort, coalesce(utility, 0) AS u FROM {A}) GROUP BY 1 HAVING count(*) >= 3")
def cohort_select(s, d):
    return quality.cohorts(atoms(s, d), 3)


RULES = [("belief", "belief.claim", quality.required("claim", "subject")), ("goal", "goal.description", quality.required("description", "objective", "desired_state")), ("episode", "episode.summary", quality.required("summary", "task")), ("preference", "preference.holder", quality.required("holder")), ("preference", "preference.strength", "try_cast(get_json_object(payload, '$.strength') as double) between 0 and 1")]


@query(f"""
WITH p AS (SELECT id, type, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM {A} WHERE payload IS NULL OR json_valid(payload)), r AS (
SELECT id, 'belief.claim' AS rule, coalesce(nullif(p->>'$.claim', ''), nullif(p->>'$.subject', '')) IS NOT NULL AS ok FROM p WHERE type = 'belief'
UNION ALL SELECT id, 'goal.description', coalesce(nullif(p->>'$.description', ''), nullif(p->>'$.objective', ''), nullif(p->>'$.desired_state', '')) IS NOT NULL FROM p WHERE type = 'goal'
UNION ALL SELECT id, 'episode.summary', coalesce(nullif(p->>'$.summary', ''), nullif(p->>'$.task', '')) IS NOT NULL FROM p WHERE type = 'episode'
UNION ALL SELECT id, 'preference.holder', coalesce(p->>'$.holder', '') <> '' FROM p WHERE type = 'preference'
UNION ALL SELECT id, 'preference.strength', coalesce(TRY_CAST(p->>'$.strength' AS double) BETWEEN 0 AND 1, false) FROM p WHERE type = 'preference')
SELECT id, rule FROM r WHERE NOT ok""")
def shape_violations(s, d):
    return quality.shape_violations(atoms(s, d).where(F.col("payload").isNull() | F.try_parse_json("payload").isNotNull()), RULES)


@query(SQL["shape_violations"].replace(" WHERE payload IS NULL OR json_valid(payload)", ""))
def shape_violations_all(s, d):
    return quality.shape_violations(atoms(s, d), RULES)


@query(f"SELECT id, CASE WHEN lifecycle_state = 'archived' AND x >= 7 THEN 'delete_archived' WHEN lifecycle_state = 'superseded' AND x >= 7 THEN 'delete_superseded' WHEN health_status = 'stale' AND x >= 14 THEN 'delete_stale' END AS action FROM (SELECT *, greatest(0, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(coalesce(updated_at, created_at)))::bigint) / 86400.0 AS x FROM {A}) WHERE action IS NOT NULL")
def retention_actions(s, d):
    return quality.retention_actions(atoms(s, d), NOW)


_DEG = f"(SELECT ref, count(*) AS degree FROM (SELECT source_ref AS ref FROM {E} UNION ALL SELECT target_ref FROM {E}) GROUP BY 1)"


@query(f"SELECT id, linked, utility, salience FROM (SELECT id, degree IS NOT NULL AS linked, utility, salience, coalesce(updated_at, created_at) AS t0 FROM {A} LEFT JOIN {_DEG} ON ref = id WHERE lifecycle_state = 'active') ORDER BY linked, utility NULLS FIRST, salience NULLS FIRST, t0 NULLS FIRST, id LIMIT 256")
def pressure_evict(s, d):
    return quality.eviction_order(atoms(s, d), graph.degrees(graph.live_edges(edges(s, d))), 256)


# ------------------------------------------------------------------------------------------------- graph
@query(f"SELECT * FROM {_DEG}")
def degree_counts(s, d):
    return graph.degrees(graph.live_edges(edges(s, d)))


@query(f"SELECT * FROM {_DEG} ORDER BY degree DESC, ref LIMIT 10")
def graph_hubs(s, d):
    return graph.hubs(graph.live_edges(edges(s, d)), 10)


@query(f"""
WITH adj AS (SELECT source_ref AS a, target_ref AS b FROM {E} UNION SELECT target_ref, source_ref FROM {E}), z AS (SELECT DISTINCT id AS ref FROM seed_atoms),
o AS (SELECT DISTINCT b AS ref FROM adj WHERE a IN (SELECT ref FROM z) AND b NOT IN (SELECT ref FROM z)),
w AS (SELECT DISTINCT b AS ref FROM adj WHERE a IN (SELECT ref FROM o) AND b NOT IN (SELECT ref FROM z) AND b NOT IN (SELECT ref FROM o))
SELECT ref, 0 AS hop FROM z UNION ALL SELECT ref, 1 FROM o UNION ALL SELECT ref, 2 FROM w""")
def two_hop_neighbors(s, d):
    return graph.neighbours(graph.live_edges(edges(s, d)), table(s, d, "seed_atoms").select(F.col("id").alias("ref")), 2)


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT source_ref AS a, target_ref AS b FROM edges WHERE relation = 'rel:similar_to' AND source_ref IS NOT NULL AND target_ref IS NOT NULL),
adj AS (SELECT a, b FROM n UNION SELECT b, a FROM n UNION SELECT a, a FROM n UNION SELECT b, b FROM n), r AS (SELECT a AS ref, a AS o FROM adj UNION SELECT r.ref, adj.b FROM r JOIN adj ON r.o = adj.a)
SELECT ref, min(o) AS component FROM r GROUP BY 1""")
def similar_components(s, d):
    return graph.components(edges(s, d).where("relation = 'rel:similar_to'"))


_W = "CASE WHEN relation IN ('rel:uses', 'rel:supports', 'rel:produced_outcome', 'rel:made_commitment', 'rel:has_capability', 'rel:has_limitation') THEN 0.9 WHEN relation IN ('rel:derived_from', 'rel:supersedes') THEN 0.75 WHEN relation IN ('rel:contradicts', 'rel:similar_to') THEN 0.65 ELSE 0.5 END"
_ACT = f"""
l AS (SELECT edge_id, source_ref AS a, target_ref AS b, {_W} / sqrt(degree) AS w FROM {E} JOIN {_DEG} ON ref = source_ref
  UNION ALL SELECT edge_id, target_ref, source_ref, 0.8 * {_W} / sqrt(degree) FROM {E} JOIN {_DEG} ON ref = target_ref),
o1 AS (SELECT b AS ref, edge_id, least(1, s * w) AS x FROM z JOIN l ON l.a = z.ref),
o AS (SELECT o1.* FROM o1 LEFT JOIN z USING (ref) WHERE x > coalesce(s, 0)),
t AS (SELECT b AS ref, least(1, x * w * 0.55) AS x FROM o JOIN l ON l.a = o.ref AND l.edge_id <> o.edge_id),
act AS (SELECT ref, max(x) AS strength FROM (SELECT ref, s AS x FROM z UNION ALL SELECT ref, x FROM o UNION ALL SELECT ref, x FROM t) GROUP BY 1)"""


@query(f"WITH z AS (SELECT DISTINCT id AS ref, 1.0::double AS s FROM seed_atoms), {_ACT} SELECT ref, round(strength, 6) AS strength FROM act")
def activation_2hop(s, d):
    seeds = table(s, d, "seed_atoms").select(F.col("id").alias("ref"), F.lit(1.0).alias("strength"))
    return graph.activation(graph.live_edges(edges(s, d)), seeds).select("ref", F.round("strength", 6).alias("strength"))


_MSG = "(SELECT DISTINCT coalesce(conversation_id, p->>'$.conversation_id') AS conversation_id, coalesce(sequence, TRY_CAST(p->>'$.sequence' AS bigint)) AS sequence, id, p->>'$.actor_ref' AS actor, lower(trim(p->>'$.role')) AS role, p->>'$.in_reply_to' AS in_reply_to FROM (SELECT *, payload::json AS p FROM interaction_event WHERE json_valid(payload)) WHERE id IS NOT NULL)"

_MSG_ALL = _MSG.replace("payload::json AS p FROM interaction_event WHERE json_valid(payload)", "CASE WHEN json_valid(payload) THEN payload::json END AS p FROM interaction_event")


@query(f"""
WITH RECURSIVE m AS (SELECT id AS ref, min(in_reply_to) AS up FROM {_MSG} GROUP BY 1),
r AS (SELECT ref AS start, 0 AS step, ref, up FROM m WHERE ref IN (SELECT id FROM {_MSG} WHERE role = 'tool')
  UNION ALL SELECT r.start, r.step + 1, m.ref, m.up FROM r JOIN m ON m.ref = r.up WHERE r.step < 6)
SELECT start, step, ref FROM r""")
def reply_chain(s, d):
    m = views.projection(messages(s, d).where(F.try_parse_json("payload").isNotNull()))
    return graph.reply_chain(m.select(F.col("id").alias("ref"), F.col("in_reply_to").alias("reply_to")), m.where("role = 'tool'").select(F.col("id").alias("start")), 6)


@query(SQL["reply_chain"].replace(_MSG, _MSG_ALL).replace("ref, up FROM m WHERE ref IN", "ref, up, [ref] AS path FROM m WHERE ref IN").replace("m.ref, m.up FROM r", "m.ref, m.up, list_append(r.path, m.ref) FROM r").replace("r.step < 6", "r.step < 6 AND NOT list_contains(r.path, m.ref)"))
def reply_chain_all(s, d):
    m = views.projection(messages(s, d))
    return graph.reply_chain(m.select(F.col("id").alias("ref"), F.col("in_reply_to").alias("reply_to")), m.where("role = 'tool'").select(F.col("id").alias("start")), 6)


@query(f"""
WITH RECURSIVE u AS (SELECT DISTINCT source_ref AS r, target_ref AS p FROM {E} WHERE relation = 'rel:derived_from'),
w AS (SELECT r AS ref, p AS ancestor, 1 AS depth FROM u UNION SELECT w.ref, u.p, w.depth + 1 FROM w JOIN u ON u.r = w.ancestor WHERE w.depth < 8),
f AS (SELECT ref, ancestor, min(depth) AS depth FROM w GROUP BY ALL)
SELECT ref, ancestor, depth, ref IN (SELECT ref FROM f WHERE ref = ancestor) AS cyclic FROM f""")
def ancestry_paths(s, d):
    return graph.ancestry(graph.live_edges(edges(s, d)), atoms=atoms(s, d))


@query(f"""
WITH RECURSIVE u AS (SELECT DISTINCT source_ref AS r, target_ref AS p FROM {E} WHERE relation = 'rel:derived_from'),
w AS (SELECT r AS ref, p AS ancestor, 1 AS depth FROM u UNION SELECT w.ref, u.p, w.depth + 1 FROM w JOIN u ON u.r = w.ancestor WHERE w.depth < 8)
SELECT DISTINCT ref, ancestor AS root FROM w WHERE ancestor NOT IN (SELECT r FROM u)""")
def ancestry_roots(s, d):
    return graph.roots(graph.ancestry(graph.live_edges(edges(s, d)), atoms=atoms(s, d)))


def _root_paths(s, d):
    paths = graph.root_paths(graph.live_edges(edges(s, d)), atoms(s, d))
    return paths, graph.evidence_paths(paths, atoms(s, d), evidence(s, d))


@query()
def provenance_roots(s, d):
    return _root_paths(s, d)[1].drop("path").distinct()


@query()
def provenance_summary(s, d):
    paths, found = _root_paths(s, d)
    return graph.provenance(found, paths)


@query()
def provenance_common_ancestors(s, d):
    return graph.common_ancestors(_root_paths(s, d)[1])


@query()
def reference_repairs(s, d):
    return quality.reference_repairs(atoms(s, d), edges(s, d), evidence(s, d))


@query(f"""
WITH e AS {E}, adj AS (SELECT source_ref AS a, target_ref AS b FROM e WHERE relation IN ('rel:supersedes', 'rel:contradicts') UNION SELECT target_ref, source_ref FROM e WHERE relation IN ('rel:supersedes', 'rel:contradicts')),
z AS (SELECT DISTINCT source_ref AS ref FROM e WHERE relation = 'rel:contradicts'),
h1 AS (SELECT DISTINCT b AS ref FROM adj WHERE a IN (FROM z) AND b NOT IN (FROM z)), h2 AS (SELECT DISTINCT b AS ref FROM adj WHERE a IN (FROM h1) AND b NOT IN (FROM z) AND b NOT IN (FROM h1)),
m AS (SELECT ref, 0 AS hop, 'seed' AS kind FROM z UNION ALL SELECT ref, 1, 'mandatory' FROM h1 UNION ALL SELECT ref, 2, 'mandatory' FROM h2),
sup AS (SELECT source_ref AS a, target_ref AS b FROM e WHERE relation = 'rel:supports' UNION SELECT target_ref, source_ref FROM e WHERE relation = 'rel:supports')
SELECT * FROM m UNION ALL SELECT DISTINCT b, 1, 'supporting' FROM sup WHERE a IN (SELECT ref FROM m) AND b NOT IN (SELECT ref FROM m)""")
def coherent_closure(s, d):
    e = graph.live_edges(edges(s, d))
    seeds = e.where("relation = 'rel:contradicts'").select(F.col("source_ref").alias("ref"))
    return graph.closure(e, seeds, ["rel:supersedes", "rel:contradicts"], ["rel:supports"], 2)


@query(f"""
WITH f AS (SELECT edge_id AS facet_id, source_ref AS atom_ref, target_ref AS subject, relation AS context, CASE WHEN version > 1 THEN 'revised' ELSE 'first' END AS intent, CASE WHEN {_CONF} >= 0.5 THEN 'positive' ELSE 'negative' END AS direction, {_CONF} AS confidence, created_at AS time_index FROM {E}),
p AS (SELECT atom_ref AS la, intent AS li, direction AS ld, confidence AS lc, lead(atom_ref) OVER w AS ra, lead(intent) OVER w AS ri, lead(direction) OVER w AS rd, lead(confidence) OVER w AS rc FROM f WINDOW w AS (PARTITION BY subject, context ORDER BY time_index NULLS FIRST, facet_id)),
r AS (SELECT *, CASE WHEN li = ri THEN CASE WHEN ld = rd THEN 'rel:supports' ELSE 'rel:contradicts' END WHEN rc >= lc + 0.1 THEN 'rel:supersedes' END AS relation FROM p WHERE ra IS NOT NULL AND ra <> la)
SELECT la AS left_ref, ra AS right_ref, relation, CASE WHEN relation = 'rel:supersedes' THEN rc ELSE least(lc, rc) END AS confidence FROM r WHERE relation IS NOT NULL""")
def facet_relations(s, d):
    return graph.facet_pairs(_facets(s, d))


def _facets(s, d):
    e = graph.live_edges(edges(s, d))
    return e.select(F.col("edge_id").alias("facet_id"), F.col("source_ref").alias("atom_ref"), F.col("target_ref").alias("subject"), F.col("relation").alias("context"), F.when(F.col("version") > 1, "revised").otherwise("first").alias("intent"), F.when(confidence() >= 0.5, "positive").otherwise("negative").alias("direction"), confidence().alias("confidence"), F.col("created_at").alias("time_index"))


_CLASSES = f"""
f AS (SELECT edge_id AS facet_id, source_ref AS atom_ref, target_ref AS subject, relation AS context, CASE WHEN version > 1 THEN 'revised' ELSE 'first' END AS intent, CASE WHEN {_CONF} >= 0.5 THEN 'positive' ELSE 'negative' END AS direction, {_CONF} AS confidence, created_at AS time_index FROM {E}),
k AS (SELECT *, min(facet_id) OVER (PARTITION BY subject, context, intent, direction, confidence) AS class_id FROM f)"""


@query(f"WITH {_CLASSES} SELECT facet_id, class_id, atom_ref, subject, context, intent, direction, confidence, time_index FROM k")
def facet_members(s, d):
    return graph.facet_members(_facets(s, d))


@query(f"""
WITH {_CLASSES},
p AS (SELECT l.class_id AS left_class, r.class_id AS right_class, CASE WHEN l.intent <> r.intent THEN 'rel:supersedes' WHEN l.direction = r.direction THEN 'rel:supports' ELSE 'rel:contradicts' END AS relation, CASE WHEN l.intent <> r.intent THEN l.confidence ELSE least(l.confidence, r.confidence) END AS confidence
  FROM k l JOIN k r USING (subject, context) WHERE l.atom_ref <> r.atom_ref AND CASE WHEN l.intent = r.intent THEN l.class_id <= r.class_id ELSE l.time_index > r.time_index AND l.confidence >= r.confidence + 0.1 END)
SELECT DISTINCT left_class, right_class, relation, round(confidence, 4) AS confidence FROM p""")
def facet_class_relations(s, d):
    return graph.facet_class_relations(graph.facet_members(_facets(s, d)))


@query(f"WITH a AS (SELECT * FROM {A} WHERE lifecycle_state = 'active') SELECT DISTINCT source_ref, target_ref, relation FROM (SELECT id AS source_ref, unnest(supersedes) AS target_ref, 'rel:supersedes' AS relation FROM a UNION ALL SELECT id, unnest(from_json(payload->'$.source_refs', '[\"varchar\"]')), 'rel:derived_from' FROM a WHERE json_valid(payload)) WHERE target_ref <> source_ref AND target_ref IN (SELECT id FROM a)")
def intrinsic_edges(s, d):
    return graph.intrinsic_edges(atoms(s, d))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT source_ref AS a, relation AS r, target_ref AS b FROM {E}), z AS (SELECT DISTINCT a AS event FROM e WHERE r = 'rel:responds_to'),
x AS (SELECT event, b AS ref, 1 AS hop, a AS src, r AS relation FROM z JOIN e ON e.a = z.event WHERE b <> event
  UNION SELECT x.event, e.b, x.hop + 1, e.a, e.r FROM x JOIN e ON e.a = x.ref WHERE x.hop < 2 AND e.b <> x.event),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY event, ref ORDER BY hop, src, relation) = 1)
SELECT event, ref, hop, relation FROM f QUALIFY row_number() OVER (PARTITION BY event ORDER BY hop, src, relation, ref) <= 5""")
def linked_records(s, d):
    e = graph.live_edges(edges(s, d))
    return graph.linked_records(e, e.where("relation = 'rel:responds_to'").select(F.col("source_ref").alias("event")), 2, 5)


# ----------------------------------------------------------------------------------------------- journal
@query("WITH e AS (SELECT DISTINCT graph_version AS g, previous_event_hash AS p, checksum AS c FROM event_journal_entry) SELECT e.g AS graph_version, CASE WHEN e.g <> 1 AND q.g IS NULL THEN 'gap' WHEN q.g IS NOT NULL AND e.p IS DISTINCT FROM q.c THEN 'broken_link' END AS problem FROM e LEFT JOIN e q ON q.g + 1 = e.g WHERE problem IS NOT NULL")
def chain_gaps(s, d):
    return journal.chain_problems(log(s, d))


@query("WITH v AS (SELECT DISTINCT graph_version AS g FROM event_journal_entry WHERE result_status = 'accepted'), x AS (SELECT g, lag(g) OVER (ORDER BY g) AS p FROM v) SELECT p + 1 AS from_version, g - 1 AS to_version FROM x WHERE g > p + 1")
def version_gaps(s, d):
    return journal.version_gaps(log(s, d).where("result_status = 'accepted'"), 512)


@query("WITH k AS (SELECT DISTINCT actor, idempotency_key, event_id, graph_version AS g, payload_digest AS pd FROM event_journal_entry WHERE idempotency_key IS NOT NULL), f AS (SELECT *, first_value(event_id) OVER w AS fe, first_value(pd) OVER w AS fp FROM k WINDOW w AS (PARTITION BY actor, idempotency_key ORDER BY g, event_id)) SELECT actor, idempotency_key, min(fe) AS first_event, count(*) AS uses, count(*) FILTER (pd <> fp) AS conflicts FROM f GROUP BY ALL HAVING count(*) > 1")
def idempotency_dedupe(s, d):
    return journal.idempotency(log(s, d))


@query("SELECT actor, event_type, count(*) AS head_version, arg_max(event_id, g) AS head_ref FROM (SELECT DISTINCT actor, event_type, graph_version AS g, event_id FROM event_journal_entry) GROUP BY ALL")
def head_current(s, d):
    return journal.heads(log(s, d))


@query("SELECT actor, event_type, row_number() OVER w AS version, event_id AS ref, accepted_at AS valid_from, lead(accepted_at) OVER w AS valid_to FROM (SELECT DISTINCT actor, event_type, graph_version, event_id, accepted_at FROM event_journal_entry) WINDOW w AS (PARTITION BY actor, event_type ORDER BY graph_version)")
def head_history_versions(s, d):
    return journal.head_history(log(s, d))


@query("SELECT edge_id, arg_max(relation, (updated_at, version)) AS relation FROM (SELECT DISTINCT edge_id, relation, coalesce(updated_at, TIMESTAMP '1970-01-01') AS updated_at, version, deleted FROM edges) GROUP BY 1 HAVING NOT arg_max(deleted, (updated_at, version))")
def fold_last_wins(s, d):
    e = edges(s, d).select("edge_id", "relation", F.coalesce("updated_at", F.timestamp_micros(F.lit(0))).alias("updated_at"), "version", "deleted")
    return journal.fold_states(e, "edge_id", "updated_at", "version").select("edge_id", "relation")


_FOLD = "(SELECT DISTINCT target_ref AS k, created_at AS g, edge_id AS p, version = 1 AS ins, deleted AS del, source_ref AS v FROM edges WHERE target_ref IS NOT NULL AND created_at IS NOT NULL)"


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g, p) AS n FROM {_FOLD}), z AS (SELECT * FROM r WHERE n = 1 OR NOT ins QUALIFY row_number() OVER (PARTITION BY k ORDER BY g DESC, p DESC) = 1) SELECT k AS key, v AS value FROM z WHERE NOT del")
def fold_first_wins(s, d):
    r = edges(s, d).where("target_ref is not null and created_at is not null").select(F.col("target_ref").alias("key"), F.col("created_at").alias("graph_version"), F.col("edge_id").alias("pos"), (F.col("version") == 1).alias("insert_only"), "deleted", F.col("source_ref").alias("value"))
    return journal.fold(r, "key").select("key", "value")


@query("WITH s AS (SELECT DISTINCT id, version FROM atoms WHERE NOT deleted), r AS (SELECT ref AS id, count(*) AS version FROM (SELECT source_ref AS ref FROM edges UNION ALL SELECT target_ref FROM edges) WHERE ref IS NOT NULL GROUP BY 1) SELECT coalesce(s.id, r.id) AS id, CASE WHEN s.id IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'unexpected' ELSE 'different' END AS problem FROM s FULL JOIN r ON s.id = r.id WHERE s.id IS NULL OR r.id IS NULL OR s.version IS DISTINCT FROM r.version")
def replay_diff(s, d):
    st = quality.live(atoms(s, d)).select("id", "version").distinct()
    re = edges(s, d).select(F.explode(F.array("source_ref", "target_ref")).alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("version"))
    return journal.diff(st, re, "id", "version")


@query("WITH c AS (SELECT DISTINCT edge_id AS id, target_ref AS t, nullif(version, 3) AS x, row_number() OVER (ORDER BY edge_id) AS pos FROM (SELECT DISTINCT edge_id, target_ref, version FROM edges)), s AS (SELECT DISTINCT id AS k, version FROM atoms), j AS (SELECT c.*, x IS NULL OR x = coalesce(version, 0) AS fits FROM c LEFT JOIN s ON k = t) SELECT id AS command_id, CASE WHEN x IS NULL THEN 'accepted' WHEN t IS NOT NULL AND fits AND id = min(CASE WHEN fits AND x IS NOT NULL THEN id END) OVER (PARTITION BY t) THEN 'accepted' ELSE 'conflict' END AS outcome FROM j")
def cas_conflicts(s, d):
    c = edges(s, d).select(F.col("edge_id").alias("command_id"), F.col("target_ref").alias("target"), F.nullif(F.col("version"), F.lit(3)).alias("expected"), F.col("edge_id").alias("position")).distinct()
    return journal.cas_conflicts(c, atoms(s, d).select(F.col("id").alias("key"), "version").distinct())


@query("WITH e AS (SELECT DISTINCT ON (event_id) event_id, graph_version AS g, payload_digest AS pd FROM event_journal_entry), q AS (SELECT * FROM e WHERE g <= (SELECT max(g) - 128 FROM e)) SELECT floor((g - 1) / 512)::bigint AS segment, min(g) AS from_version, max(g) AS to_version, count(*) AS events, sum(('0x' || substr(sha256(concat_ws('|', event_id, pd, g)), 1, 12))::hugeint)::varchar AS digest FROM q GROUP BY 1")
def journal_segments(s, d):
    return journal.segments(log(s, d), 512, 128)


# ----------------------------------------------------------------------------------------------- views
@query(f"SELECT agent, arg_min(id, (-epoch_us(coalesce(updated_at, TIMESTAMP '1970-01-01')), id)) AS id, max(updated_at) AS updated_at FROM (SELECT id, updated_at, json_extract_string(payload, '$.agent_id') AS agent FROM {A} WHERE type = 'runtime_state' AND json_valid(payload)) WHERE agent IS NOT NULL GROUP BY 1")
def self_awareness_latest(s, d):
    return views.latest_state(atoms(s, d).where(F.try_parse_json("payload").isNotNull()))


_SELF = ["self_assessment", "capability", "limitation", "runtime_state", "agentic_trace", "action_outcome"]


@query(f"SELECT agent, type, count(*) AS n, max(updated_at) AS newest FROM (SELECT type, updated_at, json_extract_string(payload, '$.agent_id') AS agent FROM {A} WHERE json_valid(payload) AND type IN ({', '.join(repr(x) for x in _SELF)})) WHERE agent IS NOT NULL GROUP BY ALL")
def self_awareness(s, d):
    return views.self_awareness(atoms(s, d).where(F.try_parse_json("payload").isNotNull()), _SELF)


@query(f"SELECT id FROM {A} WHERE type = 'commitment' AND lifecycle_state = 'active' AND id NOT IN (SELECT target_ref FROM edges WHERE NOT deleted AND relation IN ('rel:closes', 'rel:produced_outcome') AND target_ref IS NOT NULL)")
def open_commitments_anti(s, d):
    return views.open_items(atoms(s, d), edges(s, d))


@query(f"WITH e AS (SELECT DISTINCT source_ref AS a, target_ref AS b FROM edges WHERE NOT deleted AND relation = 'rel:contradicts'), r AS (SELECT * FROM {A}) SELECT y.id, count(*) AS n FROM e JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE x.updated_at > y.updated_at GROUP BY 1")
def later_counterevidence(s, d):
    return views.later_counterevidence(atoms(s, d), edges(s, d))


@query("WITH v AS (SELECT DISTINCT p, target_ref AS ref, unnest(CASE WHEN len(evidence_refs) > 0 THEN evidence_refs ELSE [NULL] END) AS e FROM (SELECT *, CASE relation WHEN 'rel:supports' THEN 1 WHEN 'rel:governed_by' THEN 2 END AS p FROM edges) WHERE p IS NOT NULL AND target_ref IS NOT NULL), h AS (SELECT ref FROM v GROUP BY 1 HAVING count(DISTINCT p) = 2), c AS (SELECT ref, e FROM v WHERE e IS NOT NULL GROUP BY ALL HAVING count(DISTINCT p) = 2) SELECT ref, coalesce((SELECT string_agg(e, ',' ORDER BY e) FROM c WHERE c.ref = h.ref), '') AS common_evidence FROM h")
def shared_view_lcd(s, d):
    p = F.when(F.col("relation") == "rel:supports", 1).when(F.col("relation") == "rel:governed_by", 2)
    v = edges(s, d).select(p.alias("party"), F.col("target_ref").alias("ref"), F.col("evidence_refs").alias("evidence")).where("party is not null and ref is not null")
    return views.shared_items(v, 2)


@query(f"SELECT * FROM {_MSG}")
def interaction_projection(s, d):
    return views.projection(messages(s, d).where(F.try_parse_json("payload").isNotNull()))


@query(SQL["interaction_projection"].replace(_MSG, _MSG_ALL))
def interaction_projection_all(s, d):
    return views.projection(messages(s, d))


@query(f"SELECT id, array_to_string(list_filter([lag(id, 3) OVER w, lag(id, 2) OVER w, lag(id, 1) OVER w], lambda x: x IS NOT NULL), ',') AS preceding FROM {_MSG} WHERE conversation_id IS NOT NULL WINDOW w AS (PARTITION BY conversation_id ORDER BY sequence NULLS FIRST, id)")
def stream_position(s, d):
    m = views.projection(messages(s, d).where(F.try_parse_json("payload").isNotNull())).where("conversation_id is not null")
    return views.stream_position(m).select("id", "preceding")


@query(SQL["stream_position"].replace(_MSG, _MSG_ALL))
def stream_position_all(s, d):
    return views.stream_position(views.projection(messages(s, d)).where("conversation_id is not null")).select("id", "preceding")


@query("WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 14400000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, session::bigint AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM y GROUP BY ALL")
def event_sessions(s, d):
    return views.sessions(events_t(s, d), "user_id", "ts", 14400)


@query("SELECT e.user_id, e.ts, e.event_id, p.value AS as_of FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_join(s, d):
    e = events_t(s, d)
    return views.as_of(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "ts", "value")


@query("WITH r AS (SELECT DISTINCT target_ref AS subject, unnest(evidence_refs) AS ref, created_at AS t0, edge_id FROM edges WHERE created_at IS NOT NULL AND target_ref IS NOT NULL) SELECT subject, edge_id, ref, row_number() OVER (PARTITION BY subject, ref ORDER BY t0, edge_id) = 1 AS first_seen FROM r WHERE ref IS NOT NULL")
def diachronic_novelty(s, d):
    r = edges(s, d).where("created_at is not null and target_ref is not null").select(F.col("target_ref").alias("subject"), "edge_id", F.col("created_at").alias("at"), F.explode("evidence_refs").alias("ref")).where("ref is not null").distinct()
    return quality.running_novelty(r, "subject", ["at", "edge_id"], "ref").select("subject", "edge_id", "ref", "first_seen")


# ------------------------------------------------------------------------------------------- retrieval
def _parts_sql(scope: str, n_scope: int, focus: tuple[str, ...] = (), suppress: tuple[str, ...] = (), boost: str = "''", held: str = "''", novelty: float = 0.0, against: bool = False) -> str:
    """CTEs up to `parts`: the components of every record's score."""

    def share(words):
        if not words:
            return "0.0::double"
        any_ = " OR ".join(f"contains(low, '{w}')" for w in words)
        return f"(CASE WHEN {any_} THEN greatest(0.75, len(list_intersect({list(words)}, toks)) / {len(words)}) ELSE len(list_intersect({list(words)}, toks)) / {len(words)} END)"

    cue = lambda c: f"CASE WHEN contains(low, '{c}') THEN 1.0 ELSE len(list_intersect({c.split()}, toks)) / {len(c.split())} END"
    counter = "CASE WHEN health_status = 'contradicted' THEN 1.0 WHEN type IN ('limitation', 'self_assessment', 'action_outcome') THEN 0.6 WHEN len(list_intersect(['failure', 'correction', 'blocked', 'risk', 'contradiction'], toks)) > 0 THEN 0.5 ELSE 0 END" if against else "0.0"
    return f"""
b0 AS (SELECT *, CASE WHEN json_valid(payload) THEN payload::json END AS p FROM (SELECT DISTINCT ON (id) * FROM atoms)),
b1 AS (SELECT *, coalesce(nullif(p->>'$.claim', ''), nullif(p->>'$.name', ''), nullif(p->>'$.description', ''), nullif(p->>'$.summary', ''), payload) AS text FROM b0),
b2 AS (SELECT *, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS toks FROM b1),
b AS (SELECT *, greatest({", ".join(cue(c) for c in CUES)})::double AS direct, {share(focus)}::double AS focus, greatest({share(suppress)}, (coalesce(type IN ({held}), false))::int)::double AS held, {counter}::double AS against,
  CASE WHEN deleted THEN 'deleted' WHEN NOT coalesce(lifecycle_state = 'active', false) THEN 'lifecycle' WHEN NOT {scope} THEN 'scope' END AS reason FROM b2),
z AS (SELECT id AS ref, greatest(direct, focus) AS s FROM b WHERE reason IS NULL AND greatest(direct, focus) > 0), {_ACT},
old AS (SELECT DISTINCT target_ref AS id FROM edges WHERE NOT coalesce(deleted, false) AND lifecycle_state = 'active' AND relation = 'rel:supersedes' AND source_ref IN (SELECT id FROM atoms WHERE NOT coalesce(deleted, false) AND lifecycle_state = 'active') AND target_ref IN (SELECT id FROM atoms WHERE NOT coalesce(deleted, false) AND lifecycle_state IN ('active', 'superseded'))),
j AS (SELECT b.*, coalesce(strength, 0) AS edge, degree, greatest(direct, focus, 0.5 * coalesce(strength, 0)) AS signal FROM b LEFT JOIN act ON act.ref = b.id LEFT JOIN {_DEG} dg ON dg.ref = b.id),
parts AS (SELECT id, text, reason, direct AS direct_cue_match, 0.0::double AS semantic_similarity, edge AS edge_activation,
  coalesce(greatest(0, 1 - greatest(0, epoch(TIMESTAMP '{NOW}')::bigint - floor(epoch(coalesce(updated_at, observed_at)))::bigint) / 2592000.0), 0)::double AS recency,
  {_CONF}::double AS confidence, least(1, coalesce(utility, 0.5))::double AS utility, least(1, coalesce(salience, 0.5))::double AS salience, least(1, coalesce(len(json_keys(scope)), 0) / {n_scope})::double AS scope_specificity,
  CASE WHEN type IN ('goal', 'commitment') THEN signal ELSE 0 END::double AS goal_relevance, CASE WHEN type = 'procedure' THEN signal ELSE 0 END::double AS procedural_applicability,
  focus AS attention_focus, (coalesce(type IN ({boost}), false))::int::double AS attention_type_boost, against AS attention_counterevidence, ({novelty} * (1 - least(1, coalesce(degree, 0) / 5)))::double AS attention_novelty, held AS attention_suppression_penalty,
  (coalesce(health_status = 'contradicted', false))::int::double AS contradiction_penalty, (coalesce(health_status = 'stale', false) OR coalesce(lifecycle_state = 'archived', false))::int::double AS staleness_penalty,
  (coalesce(health_status = 'merged', false))::int::double AS redundancy_penalty, (id IN (SELECT id FROM old))::int::double AS superseded_penalty FROM j)"""


_ASKED_SQL = """(coalesce(json_extract_string(scope, '$.tenant') IN ('tenant-1', 'global'), json_extract_string(scope, '$.tenant') IS NULL) AND coalesce(json_extract_string(scope, '$.workspace') = 'global', json_extract_string(scope, '$.workspace') IS NULL))"""
_READER_SQL = """(coalesce(json_extract_string(scope, '$.tenant') IN ('tenant-2', 'global'), json_extract_string(scope, '$.tenant') IS NULL) AND coalesce(json_extract_string(scope, '$.workspace') IN ('ws-head-002', 'global'), json_extract_string(scope, '$.workspace') IS NULL))"""
_SHOWN = ", ".join(f"round({c}, 6) AS {c}" for c in retrieval.WEIGHTS)
_ATTEND = retrieval.Attention(focus=("greenhouse", "valve", "ledger"), suppress=("snapshot",), boost_types=("goal", "procedure"), suppress_types=("episode",), novelty=0.5, counterevidence=True)
_ATTEND_SQL = dict(focus=_ATTEND.focus, suppress=_ATTEND.suppress, boost="'goal', 'procedure'", held="'episode'", novelty=0.5, against=True)
_SCORE = "least(1, greatest(0, " + " + ".join(f"{c} * {w}" for c, w in retrieval.WEIGHTS.items()) + "))"


@query(f"WITH {_parts_sql(_ASKED_SQL, 1)} SELECT id, reason, {_SHOWN} FROM parts")
def score_components(s, d):
    return retrieval.components(atoms(s, d), edges(s, d), CUES, ASKED, NOW).select("id", "reason", *[F.round(c, 6).alias(c) for c in retrieval.WEIGHTS])


@query(f"WITH {_parts_sql(_READER_SQL, 2, **_ATTEND_SQL)} SELECT id, reason, {_SHOWN} FROM parts")
def attention_components(s, d):
    return retrieval.components(atoms(s, d), edges(s, d), CUES, READER, NOW, _ATTEND).select("id", "reason", *[F.round(c, 6).alias(c) for c in retrieval.WEIGHTS])


@query(f"""
WITH RECURSIVE {_parts_sql(_READER_SQL, 2)},
sc AS (SELECT id, strlen(text)::bigint AS size, {_SCORE} AS score FROM parts WHERE reason IS NULL AND (direct_cue_match > 0 OR edge_activation > 0)),
r AS (SELECT id, size, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id)::int AS rank FROM sc QUALIFY rank <= 64),
g AS (SELECT 0 AS rank, 4000::bigint AS room, NULL::boolean AS packed UNION ALL SELECT r.rank, CASE WHEN r.size <= g.room THEN g.room - r.size ELSE g.room END, r.size <= g.room FROM g JOIN r ON r.rank = g.rank + 1)
SELECT r.rank, id, score, size, g.packed FROM r JOIN g USING (rank)""")
def packet(s, d):
    return retrieval.packet(atoms(s, d), edges(s, d), CUES, READER, NOW)


@query(f"WITH {_parts_sql(_ASKED_SQL, 1)} SELECT id, reason FROM parts WHERE reason IS NOT NULL AND direct_cue_match > 0")
def packet_omissions(s, d):
    return retrieval.omissions(retrieval.components(atoms(s, d), edges(s, d), CUES, ASKED, NOW))


@query("""
WITH RECURSIVE r AS (SELECT doc_id, strlen(text)::bigint AS size, row_number() OVER (ORDER BY strlen(text) DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL AND lang = 'fr' ORDER BY 2 DESC, 1 LIMIT 64),
g AS (SELECT 0::bigint AS rank, 6000::bigint AS room, NULL::boolean AS packed UNION ALL SELECT r.rank, CASE WHEN r.size <= g.room THEN g.room - r.size ELSE g.room END, r.size <= g.room FROM g JOIN r ON r.rank = g.rank + 1)
SELECT doc_id, r.rank::int AS rank, size, packed FROM g JOIN r USING (rank)""")
def packet_pack(s, d):
    size = F.octet_length("text").cast("bigint")
    c = docs(s, d).where("text is not null and lang = 'fr'").select("doc_id", size.alias("size")).orderBy(F.desc("size"), "doc_id").limit(64)
    c = quality.top_per_group(c.withColumn("g", F.lit(1)), "g", 64, F.desc("size"), "doc_id").drop("g")
    return retrieval.pack(c, 6000).select("doc_id", "rank", "size", "packed")


@query(SQL["packet_pack"].replace(" AND lang = 'fr'", ""))
def packet_pack_all(s, d):
    c = docs(s, d).where("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("size")).orderBy(F.desc("size"), "doc_id").limit(64)
    c = quality.top_per_group(c.withColumn("g", F.lit(1)), "g", 64, F.desc("size"), "doc_id").drop("g")
    return retrieval.pack(c, 6000).select("doc_id", "rank", "size", "packed")
