"""Euler-tour hierarchies against a walk up the parents."""

import random

from corvane.operators import hierarchy as H


def brute(pairs):
    parent = {}
    for c, p in pairs:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    nodes = sorted(set(parent) | set(parent.values()))
    chains, below = {}, dict.fromkeys(nodes, 0)
    for n in nodes:
        chain = [n]
        while chain[-1] in parent and parent[chain[-1]] not in chain:
            chain.append(parent[chain[-1]])
        chains[n] = chain
        for a in chain[1:]:
            below[a] += 1
    out = []
    for n, chain in chains.items():
        if chain[-1] in parent:
            loop = chain[chain.index(parent[chain[-1]]) :]
            out.append((n, min(loop), -1, below[n]))
        else:
            out.append((n, chain[-1], len(chain) - 1, below[n]))
    return sorted(out), chains, parent


def run(spark, pairs):
    return H.hierarchy(spark.createDataFrame(pairs, "child string, parent string"))


def check(spark, pairs):
    want, chains, parent = brute(pairs)
    h = run(spark, pairs).cache()
    got = sorted((r.node_ref, r.root_ref, r.depth, r.descendants) for r in h.collect())
    assert got == want
    return h, chains, parent


def test_random_forests_with_cycles(spark):
    rng = random.Random(3)
    pairs = [(f"n{i}", f"n{rng.randint(0, i - 1)}") for i in range(1, 60)]  # a tree
    pairs += [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("t1", "c2"), ("t2", "t1"), ("s", "s"), ("u", "s")]
    pairs += [(f"l{i}", f"l{i + 1}") for i in range(40)]  # a long chain
    pairs += pairs[:10] + [(None, "x"), ("y", None)]
    h, chains, parent = check(spark, pairs)
    spans = {r.node_ref: (r.tree_ref, r.entry, r.exit) for r in h.collect()}
    for a in ("n0", "n1", "l40", "l20"):
        inside = {n for n, (t, lo, hi) in spans.items() if t == spans[a][0] and spans[a][1] < lo < spans[a][2]}
        assert inside == {n for n, c in chains.items() if a in c[1:]}
    for block in (1 << 16, 16):  # whole tours, and tours in many blocks
        below = sorted(map(tuple, H.within(h, h, block).collect()))
        assert below == sorted((a, n) for n, c in chains.items() for a in c[1:])
        rows = H.paths(spark.createDataFrame(pairs, "child string, parent string"), block).collect()
        assert {r.node_ref: r.path for r in rows if not r.behind_cycle} == {n: c[::-1] for n, c in chains.items() if c[-1] not in parent}
        loops = {n: c for n, c in chains.items() if c[-1] in parent}
        on = {n for c in loops.values() for n in c[c.index(parent[c[-1]]) :]}
        assert {r.node_ref: r.path for r in rows if r.behind_cycle} == {n: [x for i, x in enumerate(c) if not set(c[:i]) & on][::-1] for n, c in loops.items()}
    more = spark.createDataFrame([("a", "x"), ("a", "w"), ("a", "w"), ("b", "x"), (None, "x")], "child string, parent string")
    assert list(map(tuple, H.extra_parents(more).collect())) == [("a", "x")]


def test_star_several_parents_empty(spark):
    check(spark, [(f"k{i}", "hub") for i in range(300)] + [("k1", "a"), ("k1", "zz")])
    assert run(spark, []).count() == 0
    old, H.BLOCK_BITS = H.BLOCK_BITS, 2  # siblings in many blocks
    try:
        check(spark, [(f"k{i}", "hub") for i in range(50)])
    finally:
        H.BLOCK_BITS = old


def test_links_resolve_names_and_direction(spark):
    e = spark.createDataFrame(
        [("a", "b", "part_of", False, "active", 1), ("b", "a2", "has", False, "active", 1), ("x", "y", "part_of", True, "active", 1), ("x", "z", "part_of", None, "active", 1), ("q", "z", "part_of", False, None, 1), (None, "z", "part_of", False, "active", 1), ("q", "z", "other", False, "active", 1)],
        "source_ref string, target_ref string, relation string, deleted boolean, lifecycle_state string, inverse int",
    )
    d = spark.createDataFrame([("part_of", "rel:part_of", False, False), ("has", "rel:part_of", True, True), ("other", "rel:other", False, False)], "relation string, canonical_relation string, inverse boolean, deprecated boolean")
    assert sorted(map(tuple, H.part_of_links(e.drop("inverse"), d).collect())) == [("a", "b"), ("a2", "b"), ("x", "z")]
