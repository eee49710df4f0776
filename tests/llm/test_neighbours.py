"""Neighbours against brute force: recall, copies, ties, unusable vectors."""

import json
import math

import numpy as np

from corvane.llm import neighbours as N


def frame(spark, rows):
    return spark.createDataFrame(rows, "token string, vec array<double>")


def brute(names, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {n: [names[j] for j in sorted(range(len(names)), key=lambda j: (-round(s[i, j], 12), names[j]))[:k]] for i, n in enumerate(names)}


def test_recall_of_the_lists(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 6000)] + 0.8 * rng.normal(size=(6000, 64))
    names = [f"t{i:05d}" for i in range(len(x))]
    got: dict = {}
    for r in N.nearest(frame(spark, [(n, v.tolist()) for n, v in zip(names, x)]), list_size=512, asked=500).collect():
        got.setdefault(r.token, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {n: [names[j] for j in row] for n, row in zip(names, np.argpartition(-s, 4, axis=1)[:, :5])}
    assert len(got) == len(names) and sum(map(len, got.values())) >= 4.99 * len(names)
    assert sum(len(got[n] & set(want[n])) for n in names) / (5 * len(names)) >= 0.9


def test_graph_search_finds_the_nearest_centres():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(3000, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    g, q = N.CentreGraph(c), c[:300] + 0.05 * rng.normal(size=(300, 64))
    ids, _ = g.search(q, 12)
    assert (ids[:, 0] == np.arange(300)).mean() > 0.95


def test_copies_ties_and_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(f"copy{i:02d}", (base * (i + 1)).tolist()) for i in range(9)]
    rows += [(f"r{i:03d}", rng.normal(size=64).tolist()) for i in range(150)]
    got: dict = {}
    for r in N.nearest(frame(spark, rows), block=16).collect():
        got.setdefault(r.token, []).append((r.rank, r.other))
    assert [o for _, o in sorted(got["copy08"])] == [f"copy{i:02d}" for i in range(5)]
    assert [o for _, o in sorted(got["copy00"])] == [f"copy{i:02d}" for i in range(1, 6)]
    want = brute([n for n, _ in rows if n[0] == "r"] + ["copy00"], np.array([v for n, v in rows if n[0] == "r"] + [rows[0][1]]), 5)
    assert {o for _, o in got["r007"]} - {f"copy{i:02d}" for i in range(9)} <= set(want["r007"])
    pairs = set(map(tuple, N.similar_pairs(frame(spark, rows)).collect()))
    assert pairs == {tuple(sorted((n, o))) for n, v in got.items() if n[0] == "c" for _, o in v}
    assert N.nearest(frame(spark, [])).count() == 0 and N.nearest(frame(spark, rows[:1])).count() == 0


def test_default_recall_on_vectors_without_structure_and_the_exact_mode(spark):
    x = np.random.default_rng(9).normal(size=(5000, 64))
    names = [f"t{i:05d}" for i in range(len(x))]
    df = frame(spark, [(n, v.tolist()) for n, v in zip(names, x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {n: [names[j] for j in row] for n, row in zip(names, np.argpartition(-s, 4, axis=1)[:, :5])}
    for options, least in (({"list_size": 128}, 0.9), ({"exact": True, "block": 1000}, 1.0)):
        got: dict = {}
        for r in N.nearest(df, **options).collect():
            got.setdefault(r.token, []).append((r.rank, r.other))
        assert sum(len({o for _, o in got[n]} & set(want[n])) for n in names) / (5 * len(names)) >= least
        assert all(len(v) == 5 for v in got.values())


def test_ties_beyond_k_go_to_the_smaller_token(spark):
    unit = np.eye(64)
    rows = [("q", (unit[0] + unit[1]).tolist())] + [(f"n{i:02d}", (unit[0] + unit[2 + i]).tolist()) for i in range(30)]
    got = sorted((r.rank, r.other) for r in N.nearest(frame(spark, rows), block=8).where("token = 'q'").collect())
    assert [o for _, o in got] == [f"n{i:02d}" for i in range(5)]


def test_usable_vectors(spark):
    good = [0.5] * 64
    j = lambda v: json.dumps(v)
    rows = [("a", 1, 64, j(good)), ("a", 2, 64, j([0.25] * 64)), ("a", 2, 64, j([0.25] * 64)), ("b", 1, 64, j(good)), ("b", 2, 64, j(good[:63])), ("c", 1, 32, j(good)), ("d", 1, 64, j([0.0] * 64)), ("e", 1, 64, j([math.nan] * 64)), ("f", 1, 64, "{}"), ("g", 1, 64, None), ("h", None, 64, "[" + ",".join(["1e-1"] * 64) + "]"), (None, 1, 64, j(good)), ("i", 1, 64, j(good[:63] + [None])), ("k", 1, 64, "[0.1,"), ("l", 1, 64, j(good[:63] + ["x"])), ("m", 1, None, j(good))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "token string, graph_version bigint, dimensions int, vector_json string, vec int")
    got = {r.token: r.vec[0] for r in N.usable_vectors(df).collect()}
    assert got == {"a": 0.25, "h": 0.1}
