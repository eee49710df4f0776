"""Graph operators over edges; loops run by joins on tables in the shared folder, hubs are never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import Workspace, rows_of

#: How strongly a relation passes activation on; relations not named pass 0.5.
ACTIVATION = {
    "rel:uses": 0.9, "rel:supports": 0.9, "rel:produced_outcome": 0.9, "rel:made_commitment": 0.9, "rel:has_capability": 0.9, "rel:has_limitation": 0.9,
    "rel:derived_from": 0.75, "rel:supersedes": 0.75, "rel:contradicts": 0.65, "rel:similar_to": 0.65,
}


def live_edges(edges: DataFrame) -> DataFrame:
    ok = ~F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("lifecycle_state") == "active") & F.col("source_ref").isNotNull() & F.col("target_ref").isNotNull()
    return edges.where(ok).dropDuplicates(["edge_id"])


def degrees(edges: DataFrame) -> DataFrame:
    """(ref, degree): ends counted on both sides, a self-link twice."""
    return edges.select(F.explode(F.array("source_ref", "target_ref")).alias("ref")).where("ref is not null").groupBy("ref").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "ref").limit(k)


def both_ways(edges: DataFrame) -> DataFrame:
    """(ref, other), distinct."""
    e = edges.select("source_ref", "target_ref")
    return e.toDF("ref", "other").unionByName(e.select(F.col("target_ref").alias("ref"), F.col("source_ref").alias("other"))).distinct()


def neighbours(edges: DataFrame, refs: DataFrame, hops: int = 1) -> DataFrame:
    """(ref, hop): what can be reached from refs(ref) in at most so many hops, at the least hop."""
    adj, found = both_ways(edges), refs.select("ref").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for h in range(1, hops + 1):
        step = frontier.select("ref").join(adj, "ref").select(F.col("other").alias("ref")).distinct()
        frontier = step.join(found.select("ref"), "ref", "left_anti").withColumn("hop", F.lit(h))
        found = found.unionByName(frontier)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(ref, component): the least ref that is connected to it.

    Alternating large-star and small-star rounds: every round hooks nodes onto smaller neighbours, the number of
    rounds grows with the logarithm of the longest path. A node with very many links sends each link to the least
    of its neighbours by an aggregation and a join, so no adjacency list is gathered.
    """
    ws = Workspace(edges.sparkSession, "components")
    e = edges.select(F.greatest("source_ref", "target_ref").alias("a"), F.least("source_ref", "target_ref").alias("b")).where("a is not null and b is not null")
    nodes = ws.save(e.select(F.explode(F.array("a", "b")).alias("ref")).distinct(), "nodes")
    cur = ws.save(e.where("a <> b").distinct(), "links")

    def star(links: DataFrame, large: bool) -> DataFrame:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        j = around.join(least, "a")
        if large:
            out = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    mark = None
    while True:
        nxt = ws.save(star(star(cur, True), False), "links")
        seen = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        ws.drop(cur)
        cur = nxt
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    root = cur.groupBy(F.col("a").alias("ref")).agg(F.min("b").alias("component"))
    return nodes.join(root, "ref", "left").select("ref", F.coalesce("component", "ref").alias("component"))


def relation_weight(c: Column) -> Column:
    w = F.lit(0.5)
    for name, x in ACTIVATION.items():
        w = F.when(c == name, F.lit(x)).otherwise(w)
    return w


def activation(edges: DataFrame, seeds: DataFrame, hop_decay: float = 0.55, back: float = 0.8) -> DataFrame:
    """(ref, strength): spreading activation from seeds(ref, strength) over two hops, the strongest path counts.

    A hop along an edge passes strength * weight / sqrt(degree of the node left), against it 0.8 of that, the
    second hop 0.55 of it, never more than 1. No path uses an edge twice. Of the paths that improve on what a node had
    the two strongest by different edges are carried on: whichever edge comes next, the strongest that did not use it
    is one of them, so the work grows with the links, not with paths times degree.
    """
    d = degrees(edges)
    e = edges.select("edge_id", "source_ref", "target_ref", relation_weight(F.col("relation")).alias("w"))
    out = e.join(d.withColumnRenamed("ref", "source_ref"), "source_ref").select("edge_id", F.col("source_ref").alias("ref"), F.col("target_ref").alias("other"), (F.col("w") / F.sqrt("degree")).alias("w"))
    inn = e.join(d.withColumnRenamed("ref", "target_ref"), "target_ref").select("edge_id", F.col("target_ref").alias("ref"), F.col("source_ref").alias("other"), (back * F.col("w") / F.sqrt("degree")).alias("w"))
    links = out.unionByName(inn)
    own = seeds.groupBy("ref").agg(F.max("strength").alias("had"))
    one = own.join(links, "ref").select(F.col("other").alias("ref"), "edge_id", F.least(F.lit(1.0), F.col("had") * F.col("w")).alias("s"))
    one = one.join(own, "ref", "left").where(F.col("s") > F.coalesce("had", F.lit(0.0))).drop("had")
    after = own.unionByName(one.groupBy("ref").agg(F.max("s").alias("had"))).groupBy("ref").agg(F.max("had").alias("had"))
    once = one.groupBy("ref", "edge_id").agg(F.max("s").alias("s"))
    once = once.withColumn("n", F.row_number().over(W.partitionBy("ref").orderBy(F.desc("s"), "edge_id"))).where("n <= 2")
    two = once.select("ref", F.col("edge_id").alias("used"), "s").join(links, "ref").where("edge_id <> used")
    two = two.select(F.col("other").alias("ref"), F.least(F.lit(1.0), F.col("s") * F.col("w") * hop_decay).alias("s")).groupBy("ref").agg(F.max("s").alias("had"))
    return after.unionByName(two).groupBy("ref").agg(F.max("had").alias("strength"))


def reply_chain(messages: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """(start, step, ref): each start's message, what it replies to, and so on, at most `limit` steps or to a loop.

    messages: (ref, reply_to), starts: (start).
    """
    m = messages.where(F.col("ref").isNotNull()).groupBy("ref").agg(F.min("reply_to").alias("reply_to"))
    at = starts.select("start").distinct().join(m, starts["start"] == m["ref"]).select("start", "ref", "reply_to", F.array("ref").alias("path"))
    out = at.select("start", F.lit(0).alias("step"), "ref")
    for i in range(1, limit + 1):
        at = at.select("start", "path", F.col("reply_to").alias("ref")).join(m, "ref").where(~F.array_contains("path", F.col("ref"))).select("start", "ref", "reply_to", F.concat("path", F.array("ref")).alias("path"))
        out = out.unionByName(at.select("start", F.lit(i).alias("step"), "ref"))
    return out


def parent_links(edges: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """(r, up), distinct: what a record derives from, by derived_from links and, with atoms, by the records its
    payload names in source_refs. Sources that are no record are passed over."""
    up = edges.where("relation = 'rel:derived_from'").select(F.col("source_ref").alias("r"), F.col("target_ref").alias("up"))
    if atoms is not None:
        stated = atoms.select(F.col("id").alias("r"), F.explode(F.from_json(F.get_json_object("payload", "$.source_refs"), "array<string>")).alias("up"))
        up = up.unionByName(stated.join(atoms.select(F.col("id").alias("up")), "up", "left_semi").select("r", "up"))
    return up.where("r is not null and up is not null").distinct()


def ancestry(edges: DataFrame, depth: int = 64, atoms: DataFrame | None = None) -> DataFrame:
    """(ref, ancestor, depth, cyclic): everything a record derives from, at its least depth, by parent_links().

    cyclic: the record is its own ancestor within the depth. Pairs are kept distinct in every round; the rounds end
    when one finds nothing new, or at the reference's greatest depth.
    """
    ws = Workspace(edges.sparkSession, "ancestry")
    up = ws.save(parent_links(edges, atoms), "up")
    found = ws.save(up.select(F.col("r").alias("ref"), F.col("up").alias("ancestor"), F.lit(1).alias("depth")), "found")
    frontier = found
    for i in range(2, depth + 1):
        step = frontier.join(up, F.col("ancestor") == F.col("r")).select("ref", F.col("up").alias("ancestor")).distinct()
        nxt = ws.save(step.join(found, ["ref", "ancestor"], "left_anti").withColumn("depth", F.lit(i)), "frontier")
        if not rows_of(nxt):
            break
        more = ws.save(found.unionByName(nxt), "found")
        for old in {id(x): x for x in (found, frontier)}.values():
            ws.drop(old)
        found, frontier = more, nxt
    loops = found.where("ref = ancestor").select("ref", F.lit(True).alias("loop"))
    return found.join(loops, "ref", "left").select("ref", "ancestor", "depth", F.coalesce("loop", F.lit(False)).alias("cyclic"))


def roots(ancestors: DataFrame) -> DataFrame:
    """(ref, root): the ancestors that derive from nothing themselves."""
    inner = ancestors.select(F.col("ref").alias("ancestor")).distinct()
    return ancestors.join(inner, "ancestor", "left_anti").select("ref", F.col("ancestor").alias("root"))


def root_paths(edges: DataFrame, atoms: DataFrame, depth: int = 64) -> DataFrame:
    """(ref, path, cycle): all ways of each live record up its parent_links() to a record without parents, or, with
    cycle, back to a record already on the way. Ways to what is no record end in nothing. Paths are written out one
    by one, as the reference does; their number grows with the links between levels."""
    ws = Workspace(edges.sparkSession, "paths")
    known = atoms.select(F.col("id").alias("up")).distinct().withColumn("known", F.lit(True))
    up = ws.save(parent_links(edges, atoms).join(known, "up", "left").select("r", "up", F.coalesce("known", F.lit(False)).alias("known")), "up")
    at = atoms.where(~F.coalesce("deleted", F.lit(False))).select(F.col("id").alias("ref")).distinct().select("ref", F.array("ref").alias("path"))
    out = None
    for i in range(depth + 1):
        links = up if i < depth else up.limit(0)
        j = ws.save(at.join(links, F.element_at("path", -1) == F.col("r"), "left"), "step")
        loop = F.array_contains("path", F.col("up"))
        ends = j.where("r is null").select("ref", "path", F.lit(False).alias("cycle"))
        ends = ends.unionByName(j.where(loop).select("ref", F.concat("path", F.array("up")).alias("path"), F.lit(True).alias("cycle")))
        out = ends if out is None else out.unionByName(ends)
        at = j.where(F.col("known") & ~loop).select("ref", F.concat("path", F.array("up")).alias("path"))
        if at.isEmpty():
            break
    return out


def evidence_paths(paths: DataFrame, atoms: DataFrame, evidence: DataFrame) -> DataFrame:
    """(ref, path, root_ref, kind, independence_group, testimony_family): the ways of root_paths() that are no cycle,
    led on to each evidence reference of their last record, which itself is the root if it has none."""
    a = atoms.dropDuplicates(["id"]).select(F.col("id").alias("last"), "type", F.filter("evidence_refs", lambda x: x.isNotNull()).alias("refs"))
    p = paths.where("not cycle").select("ref", "path", F.element_at("path", -1).alias("last")).join(a, "last").select("ref", "path", "last", "type", F.explode_outer("refs").alias("ev"))
    filled = lambda f: F.nullif(F.get_json_object("payload", f"$.{f}"), F.lit(""))
    e = evidence.dropDuplicates(["evidence_id"]).select(F.col("evidence_id").alias("ev"), F.coalesce(filled("independence_group"), F.nullif("source_ref", F.lit(""))).alias("g"), F.coalesce(filled("testimony_family"), F.nullif("source_type", F.lit(""))).alias("f"))
    has, j = F.col("ev").isNotNull(), p.join(e, "ev", "left")
    return j.select(
        "ref", F.when(has, F.concat("path", F.array("ev"))).otherwise(F.col("path")).alias("path"), F.coalesce("ev", "last").alias("root_ref"), F.when(has, "evidence").otherwise("atom").alias("kind"),
        F.coalesce(F.when(has, F.coalesce("g", "ev")), "last").alias("independence_group"), F.coalesce(F.when(has, F.col("f")).otherwise(F.nullif("type", F.lit(""))), F.lit("unknown")).alias("testimony_family"),
    )


def provenance(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(ref, roots, independence_groups, testimony_families, ancestry_depth, circular_support,
    self_descendant_support): found are rows of evidence_paths(), paths those of root_paths()."""
    n = lambda c: F.count_distinct(c)
    per = found.groupBy("ref").agg(n("root_ref").alias("roots"), n("independence_group").alias("independence_groups"), n("testimony_family").alias("testimony_families"), F.max(F.size("path") - 1).alias("ancestry_depth"))
    loops = paths.where("cycle").groupBy("ref").agg(F.max(F.element_at("path", -1) == F.col("ref")).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = per.join(loops, "ref", "full")
    return j.select("ref", *[zero(c) for c in per.columns[1:]], F.col("own").isNotNull().alias("circular_support"), F.coalesce("own", F.lit(False)).alias("self_descendant_support"))


def common_ancestors(found: DataFrame) -> DataFrame:
    """(ref, atom_ref, root_path_count): records between a record and its roots on more than one way."""
    between = found.select("ref", F.explode(F.array_distinct(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0))))).alias("atom_ref"))
    return between.groupBy("ref", "atom_ref").agg(F.count(F.lit(1)).alias("root_path_count")).where("root_path_count > 1")


def closure(edges: DataFrame, seeds: DataFrame, mandatory: list[str], supporting: list[str], hops: int = 3) -> DataFrame:
    """(ref, hop, kind): what must come along with the seeds by mandatory relations, in both directions, up to so
    many hops, and around that one hop of supporting relations."""
    must = neighbours(edges.where(F.col("relation").isin(*mandatory)), seeds, hops)
    near = neighbours(edges.where(F.col("relation").isin(*supporting)), must.select("ref"), 1).where("hop = 1")
    near = near.join(must.select("ref"), "ref", "left_anti")
    return must.withColumn("kind", F.when(F.col("hop") == 0, "seed").otherwise("mandatory")).unionByName(near.select("ref", "hop", F.lit("supporting").alias("kind")))


def component_units(parts: DataFrame, edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(component, refs, kind): what a connected group of records is, by the relations inside it, first that fits.

    types: optional (id, type) of the records; then their types decide as well and the kinds are finer.
    """
    rel = edges.join(parts.select(F.col("ref").alias("source_ref"), "component"), "source_ref").groupBy("component").agg(F.collect_set("relation").alias("rels"))
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("refs")).join(rel, "component", "left")
    has = lambda *names: F.coalesce(F.arrays_overlap("rels", F.array(*map(F.lit, names))), F.lit(False))
    if types is None:
        kind = F.when(has("rel:contradicts"), "conflict_set").when(has("rel:supersedes"), "decision_chain").when(has("rel:corrected_by"), "failure_correction").otherwise("related")
        return size.select("component", "refs", kind.alias("kind"))
    held = parts.join(types.select(F.col("id").alias("ref"), "type"), "ref").groupBy("component").agg(F.collect_set("type").alias("types"))
    of = lambda *names: F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, names))), F.lit(False))
    kind = F.when(has("rel:contradicts"), "conflict_set").when(has("rel:supersedes", "rel:decided"), "decision_chain").when(of("commitment") | has("rel:made_commitment"), "commitment_history")
    kind = kind.when(of("episode"), "episode").when(has("rel:corrected_by") | of("action_outcome"), "failure_correction").when(of("goal", "policy", "runtime_state"), "current_state").otherwise("related_memory")
    return size.join(held, "component", "left").select("component", "refs", kind.alias("kind"))


def learned_weight(used: Column, corrected: Column) -> Column:
    """How a link's use changes its weight: 0.03 more for each use, 0.08 less for each correction, between 0.35 and 1.25."""
    return F.least(F.lit(1.25), F.greatest(F.lit(0.35), 1 + 0.03 * used - 0.08 * corrected))


def linked_records(edges: DataFrame, events: DataFrame, depth: int, limit: int) -> DataFrame:
    """(event, ref, hop, relation): records linked from events(event), nearest first, at most `limit` an event."""
    e = edges.select("source_ref", "relation", "target_ref").distinct()
    at = events.select("event", F.col("event").alias("ref")).distinct()
    seen = None
    for h in range(1, depth + 1):
        at = at.join(e, at["ref"] == e["source_ref"]).select("event", F.col("target_ref").alias("ref"), F.lit(h).alias("hop"), "source_ref", "relation").where("event <> ref")
        seen = at if seen is None else seen.unionByName(at)
        at = at.select("event", "ref").distinct()
    first = seen.withColumn("n", F.row_number().over(W.partitionBy("event", "ref").orderBy("hop", "source_ref", "relation"))).where("n = 1")
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("event").orderBy("hop", "source_ref", "relation", "ref")))
    return ranked.where(F.col("n") <= limit).select("event", "ref", "hop", "relation")


def facet_pairs(facets: DataFrame) -> DataFrame:
    """(left_ref, right_ref, relation, confidence): relations inferred between facets of one subject and context.

    facets: (facet_id, atom_ref, subject, context, intent, direction, confidence, time_index). Neighbours in the
    order of time inside (subject, context) are compared, so a hot subject gives as many pairs as facets.
    """
    w = W.partitionBy("subject", "context").orderBy("time_index", "facet_id")
    cols = ["atom_ref", "intent", "direction", "confidence"]
    f = facets.dropDuplicates(["facet_id"])
    p = f.select(*[F.col(c).alias(f"l_{c}") for c in cols], *[F.lead(c).over(w).alias(f"r_{c}") for c in cols]).where("r_atom_ref is not null and r_atom_ref <> l_atom_ref")
    directed = F.col("l_direction").isin("positive", "negative") & F.col("r_direction").isin("positive", "negative")
    rel = F.when((F.col("l_intent") == F.col("r_intent")) & directed, F.when(F.col("l_direction") == F.col("r_direction"), "rel:supports").otherwise("rel:contradicts"))
    rel = rel.when(F.col("l_intent") == F.col("r_intent"), "rel:similar_to").when(F.col("r_confidence") >= F.col("l_confidence") + 0.1, "rel:supersedes")
    out = p.select("l_atom_ref", "r_atom_ref", rel.alias("relation"), F.when(rel == "rel:supersedes", F.col("r_confidence")).otherwise(F.least("l_confidence", "r_confidence")).alias("confidence"))
    return out.where(F.col("relation").isNotNull()).select(F.col("l_atom_ref").alias("left_ref"), F.col("r_atom_ref").alias("right_ref"), "relation", "confidence")


#: What facets of one class have in common.
FACET_CLASS = ["subject", "context", "intent", "direction", "confidence"]


def facet_members(facets: DataFrame) -> DataFrame:
    """Facets with class_id: the least facet of their class, which is all facets equal in FACET_CLASS."""
    f = facets.dropDuplicates(["facet_id"]).withColumns({c: F.coalesce(c, F.lit("")) for c in FACET_CLASS[:4]} | {"confidence": F.coalesce("confidence", F.lit(0.5))})
    return f.join(f.groupBy(*FACET_CLASS).agg(F.min("facet_id").alias("class_id")), FACET_CLASS).select("facet_id", "class_id", "atom_ref", *FACET_CLASS, "time_index")


def facet_class_relations(members: DataFrame) -> DataFrame:
    """(left_class, right_class, relation, confidence): all relations between facets of one subject and context.

    members: rows of facet_members(). A row stands for every pair of members with different records, for
    rel:supersedes for those of them whose left facet is the later one; class_pairs() writes the pairs out. Classes
    number at most as the levels of confidence do for an intent and a direction, so a hot subject stays small. A row
    is there only if such a pair is: of each class the first and last times of two different records decide.
    """
    per = members.groupBy("class_id", *FACET_CLASS, "atom_ref").agg(F.min("time_index").alias("first"), F.max("time_index").alias("last"))

    rank = lambda o: F.row_number().over(W.partitionBy("class_id").orderBy(o, "atom_ref"))
    per = per.withColumns({"first_n": rank(F.asc_nulls_last("first")), "last_n": rank(F.desc_nulls_last("last"))})
    nth = lambda c, n, x: F.max(F.when(F.col(f"{c}_n") == n, F.col(x)))
    ends = [x for c in ("first", "last") for x in (nth(c, 1, c).alias(c), nth(c, 1, "atom_ref").alias(f"{c}_atom"), nth(c, 2, c).alias(f"{c}2"))]
    k = per.groupBy("class_id", *FACET_CLASS).agg(F.min("atom_ref").alias("lo"), F.max("atom_ref").alias("hi"), *ends)
    k = Workspace(members.sparkSession, "facets").save(k, "classes")
    side = lambda s: k.select("subject", "context", *[F.col(c).alias(f"{s}_{c}") for c in k.columns if c not in ("subject", "context")])
    j = side("l").join(side("r"), ["subject", "context"])
    same = (F.col("l_intent") == F.col("r_intent")) & (F.col("l_intent") != "")
    two = "not (l_lo = l_hi and r_lo = r_hi and l_lo = r_lo)"
    later = F.expr("coalesce(l_last_atom <> r_first_atom and l_last > r_first, false) or coalesce(l_last > r_first2, false) or coalesce(l_last2 > r_first, false)")
    directed = F.col("l_direction").isin("positive", "negative") & F.col("r_direction").isin("positive", "negative")
    rel = F.when(same, F.when(~directed, "rel:similar_to").when(F.col("l_direction") == F.col("r_direction"), "rel:supports").otherwise("rel:contradicts")).otherwise("rel:supersedes")
    holds = (same & (F.col("l_class_id") <= F.col("r_class_id"))) | (~same & later & (F.col("l_confidence") >= F.col("r_confidence") + 0.1))
    conf = F.when(same, F.least("l_confidence", "r_confidence")).otherwise(F.col("l_confidence"))
    return j.where(two).where(holds).select(F.col("l_class_id").alias("left_class"), F.col("r_class_id").alias("right_class"), rel.alias("relation"), F.round(conf, 4).alias("confidence"))


def class_pairs(members: DataFrame, relations: DataFrame) -> DataFrame:
    """(left_ref, right_ref, relation, confidence): the pairs of records that rows of facet_class_relations() stand
    for. As many as the square of a subject's facets: give it the classes or members that are asked for."""
    side = lambda s: members.select(F.col("class_id").alias(f"{s}_class"), F.col("atom_ref").alias(f"{s}_ref"), F.col("time_index").alias(f"{s}_time"))
    p = relations.join(side("left"), "left_class").join(side("right"), "right_class").where("left_ref <> right_ref")
    newer = F.col("relation") == "rel:supersedes"
    p = p.where(~newer | (F.col("left_time") > F.col("right_time")))
    ref = lambda c, f: F.when(newer, F.col(c)).otherwise(f("left_ref", "right_ref")).alias(c)
    return p.select(ref("left_ref", F.least), ref("right_ref", F.greatest), "relation", "confidence").distinct()


def intrinsic_edges(atoms: DataFrame) -> DataFrame:
    """(source_ref, target_ref, relation): links a record's own fields state, between live active records."""
    live = atoms.where(~F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("lifecycle_state") == "active")).dropDuplicates(["id"])
    stated = live.select(F.col("id").alias("source_ref"), F.explode("supersedes").alias("target_ref"), F.lit("rel:supersedes").alias("relation"))
    refs = F.from_json(F.get_json_object("payload", "$.source_refs"), "array<string>")
    stated = stated.unionByName(live.select(F.col("id").alias("source_ref"), F.explode(refs).alias("target_ref"), F.lit("rel:derived_from").alias("relation")))
    ids = live.select(F.col("id").alias("target_ref"))
    return stated.where("target_ref is not null and target_ref <> source_ref").distinct().join(ids, "target_ref", "left_semi").select("source_ref", "target_ref", "relation")
