"""Queries of the general data-preparation problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import changes, hierarchy, references
from corvane.session import Workspace
from corvane.sources import table, tables


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.apply_changes(table(spark, d, "event_journal_entry"))


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The journal in four batches in order of arrival, late and repeated rows included."""
    j = table(spark, d, "event_journal_entry")
    at = F.coalesce(F.unix_micros("ingested_at"), F.lit(0))
    cuts = j.agg(F.percentile_approx(at, [0.25, 0.5, 0.75], 100)).first()[0] or [0, 0, 0]
    feed = changes.ChangeFeed(spark, f"{Workspace(spark, 'feed').root}/state")
    bounds = [None, *cuts, None]
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = j if lo is None else j.where(at > lo)
        feed.apply(part if hi is None else part.where(at <= hi), n + 1)
    return feed.current()


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.part_of_links(table(spark, d, "edges"), table(spark, d, "relation_dictionary"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, d)).select("node_ref", "root_ref", "depth", "descendants")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_links(spark, d)).where("not behind_cycle").select("node_ref", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    h = Workspace(spark, "descendants").save(hierarchy.hierarchy(_links(spark, d)), "tours")
    return hierarchy.within(h, h)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, atoms, seeds, messages, evidence, tombs = tables(spark, d, "edges", "atoms", "seed_atoms", "interaction_event", "evidence", "tombstones")
    refs = references.edge_references(edges).unionByName(references.atom_references(atoms))
    return references.orphan_references(refs, references.parent_keys(atoms, seeds, messages, evidence, tombs))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


_P1 = """
WITH RECURSIVE acc AS (
  SELECT DISTINCT event_id, actor, idempotency_key, graph_version, payload::json AS j, expected_versions AS ev
  FROM event_journal_entry WHERE result_status = 'accepted'),
once AS (
  SELECT * FROM acc
  QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY actor, idempotency_key ORDER BY graph_version, event_id) = 1),
proj AS (SELECT event_id, graph_version, ev, unnest(from_json(json_extract(j, '$.projected_atoms'), '["json"]')) AS a FROM once),
ops AS (
  SELECT event_id, graph_version, ev, json_extract_string(j, '$.atom.id') AS id, 0 AS kind, (json_extract_string(j, '$.atom.version'))::bigint AS v FROM once WHERE json_type(j, '$.atom') = 'OBJECT'
  UNION ALL SELECT event_id, graph_version, ev, json_extract_string(j, '$.after.id'), 1, (json_extract_string(j, '$.after.version'))::bigint FROM once WHERE json_type(j, '$.after') = 'OBJECT'
  UNION ALL SELECT event_id, graph_version, ev, json_extract_string(j, '$.tombstone.target_ref'), CASE WHEN json_extract_string(j, '$.tombstone.recreation_policy') = 'allow_recreate' THEN 2 ELSE 3 END, NULL FROM once WHERE json_type(j, '$.tombstone') = 'OBJECT'
  UNION ALL SELECT event_id, graph_version, ev, json_extract_string(a, '$.id'), CASE WHEN coalesce((json_extract_string(a, '$.deleted'))::boolean, false) THEN 2 WHEN (json_extract_string(a, '$.version'))::bigint = 1 THEN 0 ELSE 1 END, (json_extract_string(a, '$.version'))::bigint FROM proj),
seq AS (
  SELECT id, event_id, kind, v, list_contains(map_keys(ev), id) AS named, ev[id] AS x, row_number() OVER (PARTITION BY id ORDER BY graph_version, event_id) AS rn
  FROM ops WHERE id IS NOT NULL),
st AS (
  SELECT DISTINCT id, 0::bigint AS rn, NULL::bigint AS version, NULL::varchar AS event_id, false AS blocked FROM seq
  UNION ALL
  SELECT s.id, s.rn,
    CASE WHEN NOT (NOT s.named OR s.x = coalesce(t.version, 0)) THEN t.version
         WHEN s.kind = 0 THEN CASE WHEN t.version IS NULL AND NOT t.blocked THEN s.v ELSE t.version END
         WHEN s.kind = 1 THEN CASE WHEN t.version IS NULL THEN NULL ELSE s.v END
         ELSE NULL END,
    CASE WHEN NOT (NOT s.named OR s.x = coalesce(t.version, 0)) THEN t.event_id
         WHEN s.kind = 0 THEN CASE WHEN t.version IS NULL AND NOT t.blocked THEN s.event_id ELSE t.event_id END
         WHEN s.kind = 1 THEN CASE WHEN t.version IS NULL THEN NULL ELSE s.event_id END
         ELSE NULL END,
    t.blocked OR (s.kind = 3 AND t.version IS NOT NULL AND (NOT s.named OR s.x = t.version))
  FROM st t JOIN seq s ON s.id = t.id AND s.rn = t.rn + 1)
SELECT id AS atom_id, version, event_id FROM st
WHERE version IS NOT NULL QUALIFY rn = max(rn) OVER (PARTITION BY id)
"""
_P1 = _P1.replace("WHERE version IS NOT NULL QUALIFY rn = max(rn) OVER (PARTITION BY id)", "JOIN (SELECT id, max(rn) AS rn FROM seq GROUP BY id) USING (id, rn) WHERE version IS NOT NULL")

_P2_WALK = """
WITH RECURSIVE links AS (
  SELECT CASE WHEN inverse THEN target_ref ELSE source_ref END AS child, min(CASE WHEN inverse THEN source_ref ELSE target_ref END) AS parent
  FROM edges JOIN relation_dictionary USING (relation)
  WHERE canonical_relation = 'rel:part_of' AND NOT coalesce(deleted, false) AND lifecycle_state = 'active' AND source_ref IS NOT NULL AND target_ref IS NOT NULL
  GROUP BY 1),
nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
walk AS (
  SELECT node, node AS cur, [node] AS path FROM nodes
  UNION ALL
  SELECT node, parent, list_append(path, parent) FROM walk JOIN links ON cur = child WHERE NOT list_contains(path, parent)),
tops AS (SELECT node, cur, path, len(path) - 1 AS steps FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(path) DESC) = 1)
"""

_P2 = _P2_WALK + """
, below AS (SELECT cur, count(*) FILTER (WHERE cur <> node) AS n FROM walk GROUP BY cur),
loops AS (SELECT node, list_min(path[list_position(path, parent):]) AS least FROM tops JOIN links ON cur = child)
SELECT t.node AS node_ref, coalesce(l.least, t.cur) AS root_ref, CASE WHEN l.node IS NULL THEN t.steps ELSE -1 END::bigint AS depth, b.n AS descendants
FROM tops t LEFT JOIN loops l ON l.node = t.node JOIN below b ON b.cur = t.node
"""

_P2_PATHS = _P2_WALK + """
SELECT node AS node_ref, array_to_string(list_reverse(path), '/') AS path FROM tops WHERE cur NOT IN (SELECT child FROM links)
"""

_P4 = """
WITH rows AS (
  SELECT DISTINCT 'edges' AS table_name, edge_id AS row_id, 'source_ref' AS field_name, 0 AS space, source_ref AS ref, created_at FROM edges WHERE NOT coalesce(deleted, false)
  UNION SELECT 'edges', edge_id, 'target_ref', 0, target_ref, created_at FROM edges WHERE NOT coalesce(deleted, false)
  UNION SELECT 'edges', edge_id, 'evidence_refs', 1, unnest(evidence_refs), created_at FROM edges WHERE NOT coalesce(deleted, false)
  UNION SELECT 'atoms', id, 'evidence_refs', 1, unnest(evidence_refs), created_at FROM atoms WHERE NOT coalesce(deleted, false)),
live AS (
  SELECT 0 AS space, id AS ref, created_at AS since FROM atoms WHERE NOT coalesce(deleted, false)
  UNION ALL SELECT 0, id, created_at FROM seed_atoms UNION ALL SELECT 0, id, created_at FROM interaction_event
  UNION ALL SELECT 1, evidence_id, captured_at FROM evidence),
have AS (SELECT space, ref, CASE WHEN count(since) = count(*) THEN min(since) END AS since FROM live WHERE ref IS NOT NULL GROUP BY 1, 2),
gone AS (SELECT 0 AS space, id AS ref FROM atoms WHERE coalesce(deleted, false) UNION SELECT 0, target_ref FROM tombstones UNION SELECT 1, target_ref FROM tombstones),
judged AS (
  SELECT r.*, CASE WHEN h.ref IS NOT NULL THEN CASE WHEN h.since > r.created_at THEN 'late' END WHEN g.ref IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
  FROM rows r LEFT JOIN have h ON h.space = r.space AND h.ref = r.ref LEFT JOIN gone g ON g.space = r.space AND g.ref = r.ref
  WHERE r.ref IS NOT NULL AND r.ref <> ''),
found AS (
  SELECT DISTINCT table_name, row_id, field_name, ref AS missing_ref, reason, coalesce(strftime(created_at, '%Y-%m'), 'unknown') AS period FROM judged WHERE reason IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_batches": p1_batches, "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p4_found": p4_found, "p4_report": p4_report}

SQL = {
    "p1_found": _P1,
    "p1_batches": _P1,
    "p2_found": _P2,
    "p2_paths": _P2_PATHS,
    "p2_descendants": _P2_WALK + "SELECT cur AS node_ref, node AS below_ref FROM walk WHERE cur <> node",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_report": _P4 + 'SELECT table_name, period, reason, count(*) AS "references", count(DISTINCT missing_ref) AS refs FROM found GROUP BY ALL',
}
