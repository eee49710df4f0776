"""Queries of the corpus problems, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import conversations, lookalike, neighbours, packing, survivors, tokenizer
from corvane.sources import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.usable_vectors(table(spark, d, "token_latent_vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d))


def p3_top5(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, d)).select("token", "rank", "other", F.round("sim", 4).alias("sim"))


EM_ROUNDS = 8  # a fixed number, so that the SQL twin can be unrolled; fused_values() by itself runs until nothing moves


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "atoms"), table(spark, d, "placeholder_terms")).select("dedupe_key", "field_name", "atom_id")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    v = survivors.fused_values(table(spark, d, "atoms"), table(spark, d, "placeholder_terms"), rounds=EM_ROUNDS, close=0.0)
    return v.withColumn("p_true", F.round("p_true", 6))


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "interaction_event"), table(spark, d, "role_aliases"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select("conversation_id", "turn", "event_ref")


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), ["doc_id"])


def _budgets(spark: SparkSession, d: str) -> dict[str, int]:
    """The budgets by name, the largest capacity where a name comes again; a small fixed table."""
    t = table(spark, d, "token_budgets").where("budget_name is not null and capacity_tokens > 0")
    return {r[0]: int(r[1]) for r in t.groupBy("budget_name").agg(F.max("capacity_tokens")).collect()}


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(table(spark, d, "documents"), _budgets(spark, d))


def p8_waste(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d), _budgets(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, d, "documents"))


_P3 = """
WITH last AS (
  SELECT DISTINCT token, dimensions, vector_json FROM token_latent_vectors t
  WHERE graph_version = (SELECT max(graph_version) FROM token_latent_vectors u WHERE u.token = t.token)),
v AS (
  SELECT token, TRY_CAST(vector_json AS DOUBLE[]) AS x FROM last WHERE dimensions = 64 AND TRY_CAST(vector_json AS DOUBLE[]) IS NOT NULL),
w AS (SELECT token, list_transform(x, lambda e: coalesce(e, 0.0)) AS x FROM v WHERE len(x) = 64 AND len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND list_max(list_transform(x, lambda e: abs(e))) > 0),
s AS (
  SELECT a.token, b.token AS other, list_cosine_similarity(a.x, b.x) AS sim FROM w a JOIN w b ON a.token <> b.token
  QUALIFY row_number() OVER (PARTITION BY a.token ORDER BY sim DESC, b.token) <= 5)
"""
_P3_PAIRS = _P3 + "SELECT DISTINCT least(token, other) AS token_a, greatest(token, other) AS token_b FROM s WHERE sim >= 0.9"
_P3_TOP = _P3 + "SELECT token, row_number() OVER (PARTITION BY token ORDER BY sim DESC, other)::int AS rank, other, round(least(sim, 1.0), 4) AS sim FROM s"

_P5_USABLE = """
WITH a AS (
  SELECT DISTINCT id, updated_at, coalesce(json_extract_string(scope, '$.tenant'), '') AS source, payload::json AS j,
    coalesce(confidence.score, CASE confidence.level WHEN 'low' THEN 0.2 WHEN 'low-medium' THEN 0.35 WHEN 'medium' THEN 0.5 WHEN 'medium-high' THEN 0.75 WHEN 'high' THEN 0.9 END, 0.5) AS conf
  FROM (SELECT * FROM atoms WHERE NOT coalesce(deleted, false) AND json_valid(payload))),
b AS (SELECT *, json_extract_string(j, '$.retention.deduplication_key') AS k FROM a),
g AS (SELECT * FROM b WHERE k IN (SELECT k FROM b WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT id) > 1)),
f AS (SELECT *, unnest(['subject', 'predicate', 'value', 'unit', 'claim', 'note']) AS field_name FROM g),
v AS (
  SELECT k, id, source, conf, updated_at, field_name, regexp_replace(json_extract_string(j, '$.' || field_name), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS x FROM f),
u AS (SELECT * FROM v WHERE x IS NOT NULL AND x <> '' AND lower(x) NOT IN (SELECT term FROM placeholder_terms))"""

_P5 = _P5_USABLE + """,
n AS (SELECT g.k, g.id, g.conf, g.updated_at, (SELECT count(*) FROM u WHERE u.k = g.k AND u.id = g.id) AS m FROM g)
SELECT k AS dedupe_key, field_name, id AS atom_id FROM u
QUALIFY row_number() OVER (PARTITION BY k, field_name ORDER BY conf DESC, updated_at DESC NULLS LAST, id) = 1
UNION ALL
SELECT k, 'record', id FROM n
QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC, conf DESC, updated_at DESC NULLS LAST, id) = 1
"""

_EM = "".join(
    f"""
e{i} AS MATERIALIZED (SELECT k, field_name, x, 1 / (1 + exp(-greatest(-30, least(30, own + sum(neg) OVER (PARTITION BY k, field_name))))) AS p
  FROM (SELECT k, field_name, x, sum(n * (ln(sens / (1 - spec)) - ln((1 - sens) / spec))) AS own, sum(n * ln((1 - sens) / spec)) AS neg FROM votes JOIN q{i} USING (source) GROUP BY ALL)),
t{i} AS MATERIALIZED (SELECT *, sum(p) OVER (PARTITION BY k, field_name) AS t, sum(1 - p) OVER (PARTITION BY k, field_name) AS f FROM e{i}),
q{i + 1} AS MATERIALIZED (SELECT source, greatest(0.05, least(0.95, (sum(n * p) + 2.8) / (sum(n * t) + 4))) AS sens, greatest(0.05, least(0.95, 1 - (sum(n * (1 - p)) + 1.2) / (sum(n * f) + 4))) AS spec
  FROM votes JOIN t{i} USING (k, field_name, x) GROUP BY 1),"""
    for i in range(EM_ROUNDS)
)
_P5_VALUES = f"""{_P5_USABLE},
votes AS MATERIALIZED (SELECT k, field_name, x, source, count(DISTINCT id) AS n FROM u GROUP BY ALL),
q0 AS (SELECT DISTINCT source, 0.7::double AS sens, 0.7::double AS spec FROM votes),{_EM}
z AS (SELECT k, field_name, x, own + sum(neg) OVER (PARTITION BY k, field_name) AS z
  FROM (SELECT k, field_name, x, sum(n * (ln(sens / (1 - spec)) - ln((1 - sens) / spec))) AS own, sum(n * ln((1 - sens) / spec)) AS neg FROM votes JOIN q{EM_ROUNDS} USING (source) GROUP BY ALL))
SELECT k AS dedupe_key, field_name, x AS value, round(1 / (1 + exp(-greatest(-30, least(30, z)))), 6) AS p_true, 1 / (1 + exp(-greatest(-30, least(30, z)))) >= 0.5 AS retained FROM z"""

_P6 = """
WITH r AS (
  SELECT DISTINCT id, coalesce(conversation_id, json_extract_string(j, '$.conversation_id')) AS c, coalesce(sequence, TRY_CAST(json_extract_string(j, '$.sequence') AS bigint)) AS s,
    j IS NOT NULL AS parsed, lower(trim(json_extract_string(j, '$.role'))) AS role, json_extract_string(j, '$.in_reply_to') AS reply, coalesce(regexp_matches(json_extract_string(j, '$.content'), '[\\p{L}\\p{N}]'), false) AS says
  FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload::json END AS j FROM interaction_event)),
m AS (SELECT r.*, speaker_role AS who FROM r LEFT JOIN role_aliases a ON a.alias = r.role WHERE c IS NOT NULL),
q AS (SELECT m.*, m.reply IS NULL OR t.id IS NOT NULL AS answered FROM m LEFT JOIN m t ON t.c = m.c AND t.id = m.reply AND t.s < m.s),
k AS (
  SELECT c FROM q GROUP BY c
  HAVING bool_and(parsed) AND count(who) = count(*) AND count(s) = count(*) AND count(DISTINCT s) = count(*) AND min(s) = 1 AND max(s) = count(*) AND bool_and(answered)
    AND bool_or(who = 'human' AND says) AND max(CASE WHEN who = 'agent' AND says THEN s END) > max(CASE WHEN who = 'human' THEN s END))
SELECT c AS conversation_id, s AS turn, id AS event_ref, who AS speaker_role FROM m WHERE c IN (SELECT c FROM k)
"""

QUERIES = {"p3_found": p3_found, "p3_top5": p3_top5, "p5_found": p5_found, "p5_values": p5_values, "p6_found": p6_found, "p6_conversations": p6_conversations, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_waste": p8_waste, "p9_found": p9_found, "p9_classes": p9_classes}

SQL: dict[str, str] = {"p3_found": _P3_PAIRS, "p3_top5": _P3_TOP, "p5_found": _P5, "p5_values": _P5_VALUES, "p6_found": f"SELECT conversation_id, turn, event_ref FROM ({_P6})", "p6_conversations": _P6}
