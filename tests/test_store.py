"""Store operators on small hand-made tables; whole-table parity with SQL is in test_sql.py."""

from datetime import datetime

import pytest

from corvane.functions import scopes, text
from corvane.operators import commands, graph, journal, latent, plugins, quality, retrieval, scans, text_index, views

from pyspark.sql import functions as F


def test_three_scope_rules(spark):
    df = spark.createDataFrame([(1, '{"t":"a","w":"global"}'), (2, '{"t":"b"}'), (3, None), (4, "{broken"), (5, '{"x":"1"}')], "k int, scope string")
    m = scopes.scope_map()
    ask = {"t": "a"}
    seen = {r.k: (r.v, r.m, r.g) for r in df.select("k", scopes.scope_visible(m, ask).alias("v"), scopes.maintenance_scope_visible(m, ask).alias("m"), scopes.scope_applies(m, scopes.request(ask)).alias("g")).collect()}
    assert seen == {1: (True, True, False), 2: (False, False, False), 3: (True, True, True), 4: (True, True, True), 5: (False, True, False)}


def test_text_functions(spark):
    df = spark.createDataFrame([("The Quarry_id v2 is atom_ab12cd34ef and Greenhouse", None)], "t string, n string")
    r = df.select(text.index_tokens(F.col("t")).alias("i"), text.tokens(F.col("n")).alias("n"), text.cue_score(F.col("t"), text.tokens(F.col("t")), ["green house", "quarry_id x"]).alias("c"), text.squeeze(F.lit("a   b\nc" + "d" * 20), 8).alias("s")).first()
    assert r.i == ["ab12cd34ef", "atom", "greenhouse", "id", "quarry", "quarry_id"] and r.n == [] and r.c == 0.5 and r.s == "a b cdd…"


def test_packer_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 60), (2, 50), (3, 30), (4, 20), (5, 10)], "rank int, size bigint")
    assert [r.rank for r in retrieval.pack(df, 100).where("packed").orderBy("rank").collect()] == [1, 3, 5]
    assert retrieval.pack(df.limit(0), 100).count() == 0


def test_fold_modes(spark):
    rows = [("a", 1, 0, True, False, "x"), ("a", 2, 0, True, False, "ignored"), ("b", 1, 0, True, False, "x"), ("b", 2, 0, False, True, "gone"), ("b", 3, 0, True, False, "ignored"), ("c", 1, 0, False, False, "old"), ("c", 1, 1, False, False, "new"), ("c", 1, 1, False, False, "new")]
    df = spark.createDataFrame(rows, "key string, graph_version bigint, pos int, insert_only boolean, deleted boolean, value string")
    assert sorted((r.key, r.value) for r in journal.fold(df, "key").collect()) == [("a", "x"), ("c", "new")]


def test_chain_and_append(spark):
    new = spark.createDataFrame([(f"e{i:03d}", i, f"d{i}") for i in range(50)], "event_id string, position int, payload_digest string")
    got = journal.append(new, 7, "h7").orderBy("graph_version").collect()
    assert [r.graph_version for r in got] == list(range(8, 58)) and [r.event_id for r in got] == [f"e{i:03d}" for i in range(50)]
    assert got[0].previous_event_hash == "h7" and all(a.checksum == b.previous_event_hash for a, b in zip(got, got[1:]))
    j = spark.createDataFrame([(r.graph_version - 7, r.previous_event_hash, r.checksum) for r in got if r.graph_version != 20] + [(60, "?", "z")], "graph_version bigint, previous_event_hash string, checksum string")
    assert sorted((r.graph_version, r.problem) for r in journal.chain_problems(j).collect()) == [(14, "gap"), (60, "gap")]
    assert sorted(map(tuple, journal.version_gaps(j, 8).collect())) == [(13, 13), (51, 59)]


def test_commands(spark):
    cmd = spark.createDataFrame([("c1", 1, "w", "k1", "create", "new", None, "d1"), ("c2", 2, "w", "k1", "create", "new2", None, "d1"), ("c3", 3, "w", "k1", "create", "new3", None, "dX"), ("c4", 4, "w", None, "change", "a", 3, "d"), ("c5", 5, "w", None, "change", "a", 3, "d"), ("c6", 6, "w", None, "change", "a", 2, "d"), ("c7", 7, "w", "old", "create", "n", None, "d0"), ("c8", 8, "w", None, "create", "dead", None, "d"), ("c9", 9, "w", None, "remove", "nope", None, "d"), ("c10", 10, "w", None, "create", "b", None, "d"), ("c11", 11, "w", None, "remove", "b", None, "d")], "command_id string, position int, actor string, idempotency_key string, kind string, target string, expected bigint, payload_digest string")
    ledger = spark.createDataFrame([("w", "old", "d0")], "actor string, idempotency_key string, payload_digest string")
    state = spark.createDataFrame([("a", 3), ("b", 1)], "key string, version bigint")
    tombs = spark.createDataFrame([("dead", "block_recreate", datetime(2025, 1, 2)), ("dead", "allow_recreate", datetime(2025, 1, 1))], "target_ref string, recreation_policy string, created_at timestamp")
    ev, rej = commands.compile_commands(cmd, ledger, state, tombs)
    assert sorted((r.command_id, r.version) for r in ev.collect() if r.version) == [("c1", 1), ("c4", 4)]
    assert {r.command_id for r in ev.collect()} == {"c1", "c4", "c11"}
    assert dict(map(tuple, rej.collect())) == {"c2": "repeated", "c3": "idempotency_conflict", "c5": "version_conflict", "c6": "version_conflict", "c7": "repeated", "c8": "blocked", "c9": "unknown_target", "c10": "exists"}


def test_payload_diff_and_feedback(spark):
    a = spark.createDataFrame([("x", '{"p":1,"q":"s"}')], "id string, payload string")
    b = spark.createDataFrame([("x", '{"p":2,"r":[1]}')], "id string, payload string")
    assert sorted(map(tuple, commands.payload_diff(a, b).collect())) == [("x", "p", "changed"), ("x", "q", "removed"), ("x", "r", "added")]
    rec = spark.createDataFrame([("x", 0.99, None), ("y", 0.05, 0.5)], "id string, utility double, salience double")
    out = spark.createDataFrame([("x", "used"), ("x", "used"), ("y", "negative")], "ref string, label string")
    assert {r.id: (round(r.utility, 3), round(r.salience, 3)) for r in commands.feedback(rec, out).collect()} == {"x": (1.0, 0.54), "y": (0.0, 0.5)}


def test_components_and_activation(spark):
    rows = [(f"e{i}", f"n{i:03d}", f"n{i + 1:03d}", "rel:uses", False, "active") for i in range(60)] + [("x", "z1", "z2", "rel:uses", False, "active"), ("s", "q", "q", "rel:uses", False, "active"), ("d", "n000", "z1", "rel:uses", True, "active")]
    e = spark.createDataFrame(rows, "edge_id string, source_ref string, target_ref string, relation string, deleted boolean, lifecycle_state string")
    live = graph.live_edges(e)
    got = {r.ref: r.component for r in graph.components(live).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["z2"] == "z1" and got["q"] == "q"
    star = spark.createDataFrame([("a", "hub", f"leaf{i}", "rel:uses", False, "active") for i in range(1)] + [(f"b{i}", "hub", f"leaf{i}", "rel:uses", False, "active") for i in range(1, 4)], e.schema)
    s = {r.ref: round(r.strength, 6) for r in graph.activation(star, spark.createDataFrame([("hub", 1.0)], "ref string, strength double")).collect()}
    assert s == {"hub": 1.0, "leaf0": 0.45, "leaf1": 0.45, "leaf2": 0.45, "leaf3": 0.45}


def test_index_and_latent_vectors(spark):
    d = spark.createDataFrame([(1, "red apple pie"), (2, "red apple tart"), (3, "blue sea wave"), (4, "blue sea sand"), (5, None)], "id int, text string")
    i = text_index.postings(d, "id", "text")
    top = text_index.lexical_topk(i, "id", ["apple", "tart"], 2).collect()
    assert text_index.best_matches(d, "id", "text", ["apple", "tart"], 2).collect() == top
    assert text_index.best_matches(d, "id", "text", [], 2).count() == 0 and text_index.best_matches(d.limit(0), "id", "text", ["apple"], 2).count() == 0
    assert [r.id for r in top] == [2, 1]
    v = {r.token: r.vec for r in latent.token_vectors(i, "id", 20, 4).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert dot("red", "apple") > 0.9 and abs(dot("red", "sea")) < 0.2
    assert latent.token_vectors(i.limit(0), "id").count() == 0


def test_plugins(spark):
    r = plugins.Registry()
    r.load("built_in", "corvane.operators.plugins:missing_intrinsic_edges")
    with pytest.raises(TypeError):
        r.register("bad", 3)
    cols = "id string, payload string, supersedes array<string>, deleted boolean, lifecycle_state string"
    a = spark.createDataFrame([("n", "{}", ["o"], False, "active"), ("o", '{"source_refs":["n","n"]}', None, False, "active"), ("p", None, ["gone"], False, "active")], cols)
    e = spark.createDataFrame([("e", "n", "o", "rel:supersedes", False, "active")], "edge_id string, source_ref string, target_ref string, relation string, deleted boolean, lifecycle_state string")
    got = r.run({"atoms": a, "edges": e}).collect()
    assert [(x.source_ref, x.target_ref, x.relation) for x in got] == [("o", "n", "rel:derived_from")] and r.names() == ["built_in"]
    assert plugins.committable(r.run({"atoms": a, "edges": e})).count() == 1


def test_views_and_quality(spark):
    m = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("c", 3, "d")], "conversation_id string, sequence int, id string")
    assert {r.id: r.preceding for r in views.stream_position(m, 2).collect()} == {"a": "", "b": "a", "d": "a,b"}
    x = spark.createDataFrame([("i1", "g", 1.0), ("i2", "g", 2.0), ("i0", "g", 2.0), ("i3", None, 9.0)], "id string, k string, u double")
    assert sorted(map(tuple, quality.keep_best(x, "k", "id", "u").collect())) == [("i1", "i0"), ("i2", "i0")]
    p = spark.createDataFrame([(i,) for i in range(10)], "n int")
    assert [(r.n, r.has_more) for r in scans.page(p, "n", 7, 5).collect()] == [(8, False), (9, False)]
    assert [r.has_more for r in scans.page(p, "n", 2, 3).collect()] == [True] * 3
