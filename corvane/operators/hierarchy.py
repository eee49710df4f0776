"""Problem 2: parent-child links to full hierarchies, by leaf peeling and Euler tours with parallel list ranking.

1. Nodes get integer ids; a child keeps one parent.
2. Peeling: jumping twice as far in every round (f, f^2, f^4 ...) peels 1, 2, 4 ... layers of leaves at once. A
   node whose chain ends at a root drops out; what never drops out leads into a cycle. On that rest the images
   of the jumps shrink to the nodes on the cycles.
3. The links out of cycle nodes are cut, which leaves a forest. Its Euler tour is a linked list of two elements
   a node, entry and exit, per tree; siblings are chained in blocks of bounded size.
4. List ranking by pointer jumping gives each element its distance to the tour's end and the depth change up to
   it. From these come entry and exit positions, depth, root and the number of nodes below.

Rounds grow with the logarithm of the deepest chain and of the largest tree; every round writes a table to the
shared folder. No group is gathered in one task, nothing is collected but row counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.session import Workspace, rows_of

BLOCK_BITS = 14  # siblings are chained in blocks of at most 2**14


def part_of_links(edges: DataFrame, relations: DataFrame, relation: str = "rel:part_of") -> DataFrame:
    """(child, parent): live links whose relation resolves to the given one; an inverse relation swaps the ends.

    Links that are deleted, not in lifecycle_state active (null is not), or lack an end do not count; a null
    `deleted` counts as false.
    """
    names = relations.where(F.col("canonical_relation") == relation).select("relation", F.coalesce("inverse", F.lit(False)).alias("inverse")).dropDuplicates(["relation"])
    e = edges.where(~F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("lifecycle_state") == "active") & F.col("source_ref").isNotNull() & F.col("target_ref").isNotNull())
    e = e.select("source_ref", "target_ref", "relation").join(names, "relation")
    return e.select(F.when(F.col("inverse"), F.col("target_ref")).otherwise(F.col("source_ref")).alias("child"), F.when(F.col("inverse"), F.col("source_ref")).otherwise(F.col("target_ref")).alias("parent"))


def _encode(ws: Workspace, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (v, ref) and, for each node, (v, p): its parent's id, null for a root."""
    tree = ws.save(links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("child").agg(F.min("parent").alias("parent")), "links")
    refs = tree.select(F.col("child").alias("ref")).union(tree.select("parent")).distinct()
    nodes = ws.save(refs.select(F.monotonically_increasing_id().alias("v"), "ref"), "nodes")
    up = (
        tree.join(nodes.select(F.col("v").alias("c"), F.col("ref").alias("child")), "child")
        .join(nodes.select(F.col("v").alias("p"), F.col("ref").alias("parent")), "parent")
        .select("c", "p")
    )
    parents = ws.save(nodes.join(up, nodes["v"] == up["c"], "left").select("v", "p"), "parents")
    return nodes, parents


def _peel(ws: Workspace, parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(v, p) of the nodes that never reach a root, and (v) of those on a cycle; None if there are none."""
    far = ws.save(parents.where(F.col("p").isNotNull()), "far")
    n = rows_of(far)
    while n:
        nxt = ws.save(far.alias("a").join(far.alias("b"), F.col("a.p") == F.col("b.v")).select("a.v", "b.p"), "far")
        m = rows_of(nxt)
        ws.drop(far)
        far = nxt
        if m == n:
            break
        n = m
    if not n:
        return parents.limit(0), None
    bound = ws.save(parents.join(far.select("v"), "v", "left_semi"), "bound")
    image = ws.save(far.select(F.col("p").alias("v")).distinct(), "image")
    n = rows_of(image)
    while True:  # the jumps go on doubling until the image no longer shrinks
        jump = ws.save(far.alias("a").join(far.alias("b"), F.col("a.p") == F.col("b.v")).select("a.v", "b.p"), "far")
        nxt = ws.save(jump.select(F.col("p").alias("v")).distinct(), "image")
        m = rows_of(nxt)
        ws.drop(far)
        ws.drop(image)
        far, image = jump, nxt
        if m == n:
            return bound, image
        n = m


def _cycle_labels(ws: Workspace, on_cycle: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, label, size): the least ref on the node's cycle, and how many nodes lie on it."""
    cur = ws.save(bound.join(on_cycle, "v", "left_semi").join(nodes, "v").select("v", "p", F.col("ref").alias("label")), "cycle")
    while True:
        b = cur.select(F.col("v").alias("q"), F.col("p").alias("pp"), F.col("label").alias("other"))
        nxt = ws.save(cur.join(b, cur["p"] == b["q"]).select("v", F.col("pp").alias("p"), F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("moved")), "cycle")
        moved = nxt.where("moved").limit(1).count()
        ws.drop(cur)
        cur = nxt
        if not moved:
            break
    sizes = cur.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return ws.save(cur.select("v", "label").join(sizes, "label"), "labels")


def _tour(forest: DataFrame) -> DataFrame:
    """(e, next, hops, change): the Euler tours; element 2v is v's entry, 2v+1 its exit, hops 0 at a tour's end.

    hops and change hold what lies between the element and next: elements passed and the sum of +1 per entry
    and -1 per exit, the element itself included. Siblings are chained inside blocks of neighbouring ids, then
    block to block, so a parent with very many children is spread over many tasks.
    """
    kids = forest.where(F.col("p").isNotNull()).withColumn("block", F.shiftright("v", BLOCK_BITS))
    inside = W.partitionBy("p", "block").orderBy("v")
    kids = kids.select("p", "block", "v", F.lead("v").over(inside).alias("sib"), F.row_number().over(inside).alias("rn"))
    blocks = kids.where(F.col("rn") == 1).select("p", "block", F.col("v").alias("head"))
    across = W.partitionBy("p").orderBy("block")
    blocks = blocks.select("p", "block", F.lead("head").over(across).alias("next_head"), (F.row_number().over(across) == 1).alias("first"), "head")
    chain = kids.join(blocks.select("p", "block", "next_head"), ["p", "block"]).select("v", F.coalesce("sib", "next_head").alias("sib"))
    firsts = blocks.where("first").select(F.col("p").alias("v"), F.col("head").alias("child"))
    n = forest.join(chain, "v", "left").join(firsts, "v", "left")
    enter = F.struct((F.col("v") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("v") * 2 + 1).alias("next"), F.lit(1).alias("change"))
    leave = F.struct((F.col("v") * 2 + 1).alias("e"), F.coalesce(F.col("sib") * 2, F.col("p") * 2 + 1).alias("next"), F.lit(-1).alias("change"))
    x = n.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*")
    return x.select("e", F.col("next"), F.lit(1).cast("bigint").alias("hops"), F.col("change").cast("bigint").alias("change"), F.col("e").alias("end"))


def _rank(ws: Workspace, tour: DataFrame) -> DataFrame:
    """(e, hops, change, end): of each element, elements and depth change from it to its tour's end, and that end."""
    todo = ws.save(tour, "tour")
    while True:
        ended = todo.where(F.col("next").isNull())
        running = todo.where(F.col("next").isNotNull())
        if not running.limit(1).count():
            return todo
        t = todo.select(F.col("e").alias("q"), F.col("next").alias("n2"), F.col("hops").alias("h2"), F.col("change").alias("c2"), F.col("end").alias("end2"))
        jumped = running.join(t, running["next"] == t["q"]).select("e", F.col("n2").alias("next"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("change") + F.col("c2")).alias("change"), F.col("end2").alias("end"))
        nxt = ws.save(jumped.unionByName(ended), "tour")
        ws.drop(todo)
        todo = nxt


def hierarchy(links: DataFrame) -> DataFrame:
    """(node_ref, parent_ref, root_ref, depth, tree_ref, entry, exit, tree_length, descendants, on_cycle) of every ref in links(child, parent).

    root_ref: the topmost parent, or the least ref of the cycle the node's parents run into, then depth is -1.
    entry, exit: positions in the tour of tree_ref (for a node behind a cycle: the tour of the cycle node its
    parents meet first); a node lies below another of the same tree exactly if its entry lies between the
    other's entry and exit. descendants: other nodes whose chain of parents passes through the node.
    Repeated links count once; of several parents the least ref counts (extra_parents() names the others); rows with a null end are ignored; an
    empty table gives an empty table; a self-link is a cycle of one.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    nodes, parents = _encode(ws, links)
    bound, on_cycle = _peel(ws, parents)
    forest = parents
    if on_cycle is not None:
        cut = on_cycle.select("v", F.lit(True).alias("cut"))
        forest = ws.save(parents.join(cut, "v", "left").select("v", F.when(F.col("cut").isNull(), F.col("p")).alias("p")), "forest")
    ranks = _rank(ws, _tour(forest))
    v = F.shiftright("e", 1)
    by_node = ranks.groupBy(v.alias("v")).agg(
        F.max(F.when(F.col("e") % 2 == 0, F.col("hops"))).alias("h_in"),
        F.max(F.when(F.col("e") % 2 == 1, F.col("hops"))).alias("h_out"),
        F.max(F.when(F.col("e") % 2 == 0, -F.col("change"))).alias("level"),
        F.max(F.shiftright("end", 1)).alias("tree"),
    )
    by_node = ws.save(by_node.select("v", "tree", F.col("level").alias("level"), F.col("h_in").alias("h_in"), "h_out", F.floor((F.col("h_in") - F.col("h_out") - 1) / 2).cast("bigint").alias("below")), "ranked")
    top = by_node.where(F.col("v") == F.col("tree")).select("tree", F.col("h_in").alias("length"))
    out = by_node.join(top, "tree").join(nodes.select(F.col("v").alias("tree"), F.col("ref").alias("tree_ref")), "tree")
    if on_cycle is None:
        out = out.withColumns({"label": F.lit(None).cast("string"), "cycle_nodes": F.lit(None).cast("bigint"), "on_cycle": F.lit(False)})
    else:
        labels = _cycle_labels(ws, on_cycle, bound, nodes)
        tops = labels.select(F.col("v").alias("tree"), "label")
        total = top.join(tops, "tree").groupBy("label").agg(F.sum(F.col("length") / 2).cast("bigint").alias("cycle_nodes"))
        own = labels.join(total, "label").select(F.col("v").alias("tree"), "label", "cycle_nodes")
        out = out.join(own, "tree", "left").withColumn("on_cycle", F.col("label").isNotNull() & (F.col("v") == F.col("tree")))
    up = parents.join(nodes.select(F.col("v").alias("p"), F.col("ref").alias("parent_ref")), "p", "left").select("v", "parent_ref")
    return (
        out.join(nodes.select("v", F.col("ref").alias("node_ref")), "v")
        .join(up, "v")
        .select(
            "node_ref",
            "parent_ref",
            F.coalesce("label", "tree_ref").alias("root_ref"),
            F.when(F.col("label").isNotNull(), F.lit(-1)).otherwise(F.col("level")).cast("bigint").alias("depth"),
            "tree_ref",
            (F.col("length") - F.col("h_in")).alias("entry"),
            (F.col("length") - F.col("h_out")).alias("exit"),
            F.col("length").alias("tree_length"),
            F.when(F.col("on_cycle"), F.col("cycle_nodes") - 1).otherwise(F.col("below")).cast("bigint").alias("descendants"),
            "on_cycle",
        )
    )


def extra_parents(links: DataFrame) -> DataFrame:
    """(child, parent): the stated parents that a hierarchy leaves out because the child keeps its least one."""
    l = links.where("child is not null and parent is not null").select("child", "parent").distinct()
    kept = l.groupBy("child").agg(F.min("parent").alias("kept"))
    return l.join(kept, "child").where("parent <> kept").select("child", "parent")


_SWEPT = "node_ref string, path array<string>, behind_cycle boolean"


def _sweep(t: pa.Table) -> pa.Table:
    """The paths of one block of tours, by one pass in order of entry with the open intervals on a stack."""
    t = t.sort_by([("tree_ref", "ascending"), ("entry", "ascending")])
    refs, out, behind, open_, tree = [], [], [], [], None
    for at, entry, leave, ref, carried, cyclic in zip(*(t.column(c).to_pylist() for c in ("tree_ref", "entry", "exit", "node_ref", "carried", "cyclic"))):
        if at != tree:
            tree, open_ = at, []
        while open_ and open_[-1][0] < entry:
            open_.pop()
        open_.append((leave, ref))
        if not carried:
            refs.append(ref)
            out.append([r for _, r in open_])
            behind.append(cyclic)
    return pa.table({"node_ref": pa.array(refs, pa.string()), "path": pa.array(out, pa.list_(pa.string())), "behind_cycle": pa.array(behind, pa.bool_())})


def paths(links: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(node_ref, path, behind_cycle): the refs from the top of the node's tree down to the node, read off the tours.

    A tour is cut into blocks of positions, small tours share a block. The intervals that are open where a block
    begins are handed to it, so every block is swept by itself. For nodes behind a cycle the top is the cycle's node
    that their parents meet first. Arguments as for hierarchy().
    """
    ws = Workspace(links.sparkSession, "paths")
    h = hierarchy(links).select("node_ref", "tree_ref", "entry", "exit", "tree_length", (F.col("depth") < 0).alias("cyclic"))
    h = ws.save(h, "tours")
    shared = max(1, 2 * rows_of(h) // block + 1)
    small = F.col("tree_length") <= block
    grp = F.when(small, F.concat(F.lit("s"), F.pmod(F.xxhash64("tree_ref"), F.lit(shared)))).otherwise(F.concat(F.lit("t"), "tree_ref"))
    at = lambda c: F.when(small, 0).otherwise(F.floor(F.col(c) / block)).cast("bigint")
    own = h.select(grp.alias("grp"), at("entry").alias("blk"), at("exit").alias("last"), "tree_ref", "entry", "exit", "node_ref", "cyclic")
    carried = own.where("last > blk").withColumn("blk", F.explode(F.sequence(F.col("blk") + 1, "last"))).withColumn("carried", F.lit(True))
    every = own.withColumn("carried", F.lit(False)).unionByName(carried).drop("last")
    return every.groupBy("grp", "blk").applyInArrow(_sweep, _SWEPT)


def within(h: DataFrame, above: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(node_ref, below_ref): all records below each ref of `above`(node_ref), read off the tour intervals.

    h is the result of hierarchy(), best saved. An interval meets only the blocks of positions it spans, so the work is
    that of the answer and at most two blocks more. Below a node on a cycle lies all that leads into the cycle.
    """
    at = lambda c: F.floor(F.col(c) / block).cast("bigint")
    mine = h.join(above.select("node_ref").distinct(), "node_ref", "left_semi")
    a = mine.where("not on_cycle").select("node_ref", "tree_ref", F.col("entry").alias("lo"), F.col("exit").alias("hi"), F.explode(F.sequence(at("entry"), at("exit"))).alias("blk"))
    b = h.select(F.col("node_ref").alias("below_ref"), "tree_ref", F.col("entry").alias("at"), at("entry").alias("blk"))
    inside = a.join(b, ["tree_ref", "blk"]).where((F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))).select("node_ref", "below_ref")
    loops = mine.where("on_cycle").select("node_ref", "root_ref").join(h.where("depth < 0").select(F.col("node_ref").alias("below_ref"), "root_ref"), "root_ref").where("node_ref <> below_ref")
    return inside.unionByName(loops.select("node_ref", "below_ref"))
