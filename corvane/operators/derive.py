"""Judgements derived from records one by one or from their neighbours: labels, utility, health, responsibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.records import confidence, parsed
from corvane.functions.text import first_filled
from corvane.operators import graph, quality, text_index
from corvane.operators.quality import live
from corvane.session import Workspace

#: Words that speak for a label, and how strongly.
LABEL_WORDS = {
    "preference": (0.74, ("prefer", "preference", "avoid", "likes")),
    "procedure": (0.72, ("step", "procedure", "fallback", "rollback")),
    "agentic_trace": (0.70, ("failed", "blocked", "success", "correction")),
    "belief": (0.68, ("should", "claim", "belief", "is true")),
}
#: Relations that state structure rather than association.
STRUCTURAL = ("rel:attributed_to", "rel:constrained_by", "rel:corrected_by", "rel:derived_from", "rel:has_capability", "rel:has_limitation", "rel:made_commitment", "rel:part_of", "rel:produced_outcome", "rel:supersedes", "rel:uses")
#: Keys under which an object names a record, in order.
REF_KEYS = ("id", "atom_ref", "atom_id", "source_ref", "target_ref", "ref")


def label(c: Column) -> tuple[Column, Column]:
    """(label, score) of a text by the words it contains; strongest label first, semantic at 0.5 without any."""
    low, name, score = F.lower(c), F.lit("semantic"), F.lit(0.5)
    for k, (s, words) in sorted(LABEL_WORDS.items(), key=lambda x: x[1][0]):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        name, score = F.when(hit, F.lit(k)).otherwise(name), F.when(hit, F.lit(s)).otherwise(score)
    return name, score


def utility(base: Column, reused: Column, corrected: Column) -> Column:
    """base + 0.03 a successful use - 0.05 a correction, ten of each at most, held between 0 and 1."""
    raw = F.coalesce(base, F.lit(0.5)) + F.least(reused, F.lit(10)) * 0.03 - F.least(corrected, F.lit(10)) * 0.05
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def proposed_health(corrected: Column, conf: Column) -> Column:
    return F.when(corrected > 0, "confounding").when(conf < 0.25, "low_utility").otherwise("healthy")


def use_counts(edges: DataFrame) -> DataFrame:
    """(id, reused, corrected): supporting and contradicting links onto each record."""
    e = graph.live_edges(edges)
    return e.groupBy(F.col("target_ref").alias("id")).agg(F.count_if(F.col("relation").isin("rel:supports", "rel:uses")).alias("reused"), F.count_if(F.col("relation").isin("rel:contradicts", "rel:corrected_by")).alias("corrected"))


def judged(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, utility, health): what the links onto each live record propose."""
    a = live(atoms).dropDuplicates(["id"]).select("id", "utility", confidence().alias("c")).join(use_counts(edges), "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.select("id", utility(F.col("utility"), n("reused"), n("corrected")).alias("utility"), proposed_health(n("corrected"), F.col("c")).alias("health"))


def structured_refs(json: Column) -> Column:
    """Distinct refs of a payload value: a string, an object with one of the id keys, or a list of either."""
    one = lambda x: F.when(F.get_json_object(x, "$").startswith("{"), first_filled(*[F.get_json_object(x, f"$.{k}") for k in REF_KEYS])).otherwise(F.trim(x))
    items = F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.isNotNull(), F.array(json)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(items, one), lambda x: x.isNotNull() & (x != "")))


def responsibility(agent: str, payload: str = "payload") -> Column:
    """Who answers for a record: stated, else by its agent, else external if constraints are named."""
    g = lambda f: F.get_json_object(parsed(payload), f"$.{f}")
    said, who = F.lower(F.coalesce(g("responsibility"), F.lit(""))), first_filled(g("agent_id"), g("subject_agent"))
    named = first_filled(g("external_constraints"), g("external_actor"))
    return F.when(said.isin("shared_system", "external"), said).when(who == agent, "self").when(who.isNotNull(), "other_agent").when(named.isNotNull() & ~named.isin("[]", "{}", "false"), "external").otherwise("unknown")


def recall(atoms: DataFrame, agent: str, types: list[str]) -> DataFrame:
    """(type, responsibility, status, n): an agent's view of what was done, by stated status, outcome or result."""
    g = lambda f: F.get_json_object(parsed(), f"$.{f}")
    status = F.lower(F.coalesce(first_filled(g("status"), g("outcome"), g("result")), F.lit("")))
    return live(atoms).where(F.col("type").isin(*types)).dropDuplicates(["id"]).groupBy("type", responsibility(agent).alias("responsibility"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def calibration(atoms: DataFrame) -> DataFrame:
    """(agent, claims, unverified, rate): capability records without evidence, per agent."""
    a = live(atoms).where("type = 'capability'").dropDuplicates(["id"]).select(F.get_json_object("payload", "$.agent_id").alias("agent"), (F.coalesce(F.size(F.filter("evidence_refs", lambda x: F.coalesce(x, F.lit("")) != "")), F.lit(0)) <= 0).alias("bare"))
    return a.where("agent is not null").groupBy("agent").agg(F.count(F.lit(1)).alias("claims"), F.count_if("bare").alias("unverified"), F.round(F.avg(F.col("bare").cast("double")), 4).alias("rate"))


def capability_unavailable(status: Column) -> Column:
    """A capability's JSON status says no: false, a denying word, or an object that denies."""
    word = F.lower(F.trim(status))
    return F.coalesce(word.isin("denied", "disabled", "false", "unavailable") | (F.get_json_object(status, "$.available") == "false") | (F.lower(F.get_json_object(status, "$.permission")) == "denied"), F.lit(False))


def relation_class(c: Column) -> Column:
    return F.when(c.isin(*STRUCTURAL), "structural").otherwise("associative")


def hot_edges(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Live edges between known records, none proposed, archived ones only by derivation or replacement."""
    a = live(atoms).select("id", "lifecycle_state").dropDuplicates(["id"])
    e = graph.live_edges(edges).join(a.select(F.col("id").alias("source_ref"), F.col("lifecycle_state").alias("s")), "source_ref").join(a.select(F.col("id").alias("target_ref"), F.col("lifecycle_state").alias("t")), "target_ref")
    proposed = F.coalesce((F.col("s") == "proposed") | (F.col("t") == "proposed"), F.lit(False))
    archived = F.coalesce((F.col("s") == "archived") | (F.col("t") == "archived"), F.lit(False))
    return e.where(~proposed & (F.col("relation").isin("rel:derived_from", "rel:supersedes") | ~archived)).select("edge_id", "source_ref", "target_ref", "relation")


def edges_to_retire(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """(edge_id, reason): live edges with a deleted end, or an end that no record bears."""
    a = atoms.groupBy("id").agg(F.min(F.coalesce("deleted", F.lit(False))).alias("gone"))
    e = graph.live_edges(edges).select("edge_id", F.explode(F.array("source_ref", "target_ref")).alias("id")).join(a, "id", "left")
    worst = e.groupBy("edge_id").agg(F.max(F.coalesce(F.col("gone"), F.lit(False))).alias("gone"), F.max(F.col("gone").isNull()).alias("unknown"))
    return worst.where("gone or unknown").select("edge_id", F.when(F.col("gone"), "deleted_end").otherwise("unknown_end").alias("reason"))


def edges_to_restore(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Ids of deleted edges whose ends are live records again."""
    a = live(atoms).select("id").distinct()
    e = edges.where(F.coalesce(F.col("deleted"), F.lit(False))).select("edge_id", "source_ref", "target_ref").dropDuplicates(["edge_id"])
    return e.join(a.withColumnRenamed("id", "source_ref"), "source_ref", "left_semi").join(a.withColumnRenamed("id", "target_ref"), "target_ref", "left_semi").select("edge_id")


def coverage(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: records, those in a window (active), edges inside, across and outside it."""
    w = live(atoms).where("lifecycle_state = 'active'").select("id").distinct()
    e = graph.live_edges(edges).select("edge_id", "source_ref", "target_ref")
    s = w.select(F.col("id").alias("source_ref"), F.lit(1).alias("a"))
    t = w.select(F.col("id").alias("target_ref"), F.lit(1).alias("b"))
    j = e.join(s, "source_ref", "left").join(t, "target_ref", "left").select((F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("ends"))
    return j.agg(F.count_if(F.col("ends") == 2).alias("inside"), F.count_if(F.col("ends") == 1).alias("across"), F.count_if(F.col("ends") == 0).alias("outside")).withColumn("records", w.agg(F.count(F.lit(1))).scalar())


def frame(atoms: DataFrame, edges: DataFrame, cues: list[str], mandatory: list[str], supporting: list[str], k: int = 32, typed: bool = False) -> DataFrame:
    """(component, ref, hop, kind, unit): what a question's best records must be read with, grouped and typed.

    Seeds are the k best records by words; around them the closure by mandatory and supporting relations; connected
    parts of it are units, typed by the relations inside and, if typed is set, by the types of their records.
    """
    ws = Workspace(atoms.sparkSession, "frame")
    seeds = ws.save(text_index.best_matches(quality.rendered(live(atoms)), "id", "text", cues, k).select(F.col("id").alias("ref")), "seeds")
    e = ws.save(graph.live_edges(edges).where(F.col("relation").isin(*mandatory, *supporting)).select("source_ref", "target_ref", "relation").distinct(), "edges")
    around = ws.save(graph.closure(e, seeds, mandatory, supporting, 2), "around")
    refs = around.select("ref")
    inner = ws.save(e.join(refs.withColumnRenamed("ref", "source_ref"), "source_ref", "left_semi").join(refs.withColumnRenamed("ref", "target_ref"), "target_ref", "left_semi"), "inner")
    parts = graph.components(inner)
    own = around.join(parts, "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    units = graph.component_units(own.select("ref", "component"), inner, live(atoms).select("id", "type").distinct() if typed else None)
    return own.join(units.select("component", F.col("kind").alias("unit")), "component").select("component", "ref", "hop", "kind", "unit")


def work_budgets(budgets: DataFrame) -> DataFrame:
    """(budget_name, allowance, n): how much a frame of so many bytes may look at. budgets: (budget_name, bytes)."""
    share = {"candidate_atoms": (32, 32), "continuation_edges": (4, 512), "mandatory_atom_expansions": (8, 256), "mandatory_edges": (16, 128)}
    rows = [F.struct(F.lit(name).alias("allowance"), F.greatest(F.lit(least), F.floor(F.col("bytes") / per)).cast("bigint").alias("n")) for name, (least, per) in share.items()]
    return budgets.select("budget_name", F.explode(F.array(*rows)).alias("x")).select("budget_name", "x.allowance", "x.n")


def tally(parts: dict[str, DataFrame]) -> DataFrame:
    """(finding, n): how many rows each table has."""
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
        out = n if out is None else out.unionByName(n)
    return out
