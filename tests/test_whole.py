"""Whole results: what lies beyond a neighbour, a depth, a language or a payload that parses."""

import __spark_entry__ as entry
from corvane.functions import vectors
from corvane.operators import graph

FACET = "facet_id string, atom_ref string, subject string, context string, intent string, direction string, confidence double, time_index int"


def test_facets_meet_all_of_their_subject(spark):
    rows = [("f1", "a", "s", "c", "x", "positive", 0.5, 1), ("f2", "b", "s", "c", "y", "positive", 0.5, 2), ("f3", "b", "s", "c", "y", "neutral", 0.9, 3), ("f4", "d", "s", "c", "x", "negative", 0.7, 4), ("f5", "a", "s", "c", "x", "positive", 0.5, 5), ("f6", "e", "s", "c", "x", "positive", 0.5, 0), ("f7", "a", "s", "other", "x", "negative", 0.9, 9), ("f8", "g", "s", "c", "y", "neutral", 0.4, None)]
    rows += [("f8", *rows[-1][1:])]
    m = graph.facet_members(spark.createDataFrame(rows, FACET))
    got = {tuple(r) for r in graph.class_pairs(m, graph.facet_class_relations(m)).collect()}
    want = set()
    for _, a, s, c, i, d, x, t in rows:
        for _, b, s2, c2, i2, d2, y, u in rows:
            if a == b or (s, c) != (s2, c2):
                continue
            if i == i2:
                rel = "rel:similar_to" if "neutral" in (d, d2) else "rel:supports" if d == d2 else "rel:contradicts"
                want.add((min(a, b), max(a, b), rel, min(x, y)))
            elif None not in (t, u) and t > u and x >= y + 0.1:
                want.add((a, b, "rel:supersedes", x))
    assert got == want and ("a", "d", "rel:contradicts", 0.5) in got


def test_ancestry_goes_to_the_top(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "rel:derived_from") for i in range(20)] + [(f"c{i:02d}", f"c{(i + 1) % 12:02d}", "rel:derived_from") for i in range(12)], "source_ref string, target_ref string, relation string")
    a = spark.createDataFrame([("n20", '{"source_refs": ["top", "unknown", "n20"]}'), ("top", None), ("x", "{broken")], "id string, payload string")
    got = {(r.ref, r.ancestor): (r.depth, r.cyclic) for r in graph.ancestry(e, atoms=a).collect()}
    assert got["n00", "n20"] == (20, False) and got["n00", "top"] == (21, False) and ("n20", "unknown") not in got
    assert got["c00", "c00"] == (12, True)
    b = spark.createDataFrame([("n20", '{"source_refs": ["top"]}'), ("top", None)], "id string, payload string")
    assert {r.root for r in graph.roots(graph.ancestry(e, atoms=b)).where("ref = 'n00'").collect()} == {"top"}


def run(spark, tmp_path, name, **tables):
    for n, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{n}.parquet")
    return sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())


def test_texts_of_all_languages(spark, tmp_path):
    docs = ([(1, "abc", "en"), (2, "abc", "DE"), (3, "abc", None), (4, "x\u2003" * 60, "vi"), (5, None, "fr")], "doc_id long, text string, lang string")
    assert run(spark, tmp_path, "char_ngrams_all", documents=docs) == sorted([("^ab", 3), ("abc", 3), ("bc$", 3), ("^abc", 3), ("abc$", 3)])
    assert run(spark, tmp_path, "truncated_text_all") == [(4, ("x " * 40).strip() + "…")]
    assert [(r[0], r[3]) for r in run(spark, tmp_path, "packet_pack_all")] == [(1, True), (2, True), (3, True), (4, True)]


def test_broken_payloads_count(spark, tmp_path):
    broken = ['{"claim": "x"', '{"claim": "x"} y', None]
    atoms = ([(f"b{i}", "belief", p, False) for i, p in enumerate([*broken, '{"claim": "x"}'])], "id string, type string, payload string, deleted boolean")
    assert run(spark, tmp_path, "shape_violations_all", atoms=atoms) == [(f"b{i}", "belief.claim") for i in range(3)]
    assert run(spark, tmp_path, "rendered_text_all") == [("b0", broken[0]), ("b1", broken[1]), ("b2", None), ("b3", "x")]
    assert run(spark, tmp_path, "filled_fields_all") == [("b0", 0), ("b1", 0), ("b2", 0), ("b3", 1)]
    assert run(spark, tmp_path, "cluster_keys_all") == [("claim x", 2, "b0")]
    ok = '{"role": "tool", "in_reply_to": "m2"}'
    said = ([("m1", "c", 1, ok), ("m2", "c", 2, "{broken"), ("m3", "c", 3, None), ("m4", "c", 4, ok)], "id string, conversation_id string, sequence bigint, payload string")
    assert run(spark, tmp_path, "stream_position_all", interaction_event=said) == [("m1", ""), ("m2", "m1"), ("m3", "m1,m2"), ("m4", "m1,m2,m3")]
    assert len(run(spark, tmp_path, "interaction_projection_all")) == 4
    assert run(spark, tmp_path, "reply_chain_all") == [("m1", 0, "m1"), ("m1", 1, "m2"), ("m4", 0, "m4"), ("m4", 1, "m2")]


def test_provenance_and_reference_repair(spark, tmp_path):
    atoms = ([(i, "belief", p, r, False, "active") for i, p, r in (("a", '{"source_refs": ["b", "c"]}', ["e1", "b", "gone", "b"]), ("b", None, None), ("c", None, None), ("d", None, ["e1", "e2"]), ("f", None, None), ("l", None, None))], "id string, type string, payload string, evidence_refs array<string>, deleted boolean, lifecycle_state string")
    links = [("b", "d"), ("c", "d"), ("c", "f"), ("c", "nothing"), ("l", "l")]
    edges = ([(f"x{i}", s, t, "rel:derived_from", ["e1"] if i else ["a"], False, "active") for i, (s, t) in enumerate(links)], "edge_id string, source_ref string, target_ref string, relation string, evidence_refs array<string>, deleted boolean, lifecycle_state string")
    evidence = ([("e1", "web", "s1", '{"independence_group": "g"}'), ("e2", "log", "s2", '{"testimony_family": "t"}')], "evidence_id string, source_type string, source_ref string, payload string")
    got = run(spark, tmp_path, "provenance_roots", atoms=atoms, edges=edges, evidence=evidence)
    assert [r[1:] for r in got if r[0] == "a"] == [("e1", "evidence", "g", "web"), ("e2", "evidence", "s2", "t"), ("f", "atom", "f", "belief")]
    summary = {r[0]: r[1:] for r in run(spark, tmp_path, "provenance_summary")}
    assert summary["a"] == (3, 3, 3, 3, False, False) and summary["f"] == (1, 1, 1, 0, False, False) and summary["l"] == (0, 0, 0, 0, True, True)
    assert [r[1:] for r in run(spark, tmp_path, "provenance_common_ancestors") if r[0] == "a"] == [("b", 2), ("c", 3), ("d", 4)]
    assert run(spark, tmp_path, "reference_repairs") == [("atom", "a", ["e1"], ["b"], ["gone"], ["b", "c"], ["gone"]), ("edge", "x0", [], ["a"], [], ["a"], [])]


def test_proposals_and_duplicates_of_whole_records(spark, tmp_path):
    rows = [("a", "belief", '{"x": 1, "source_refs": ["b"]}', None, False, "active"), ("b", "belief", '{"y": 1, "z": 2}', None, False, "active"), ("c", "belief", '{"z": 2, "y": 1}', None, False, "active"), ("d", "belief", "{broken", None, False, "active"), ("e", "belief", "{broken", None, False, "active")]
    atoms = ([(*r, None, None) for r in rows], "id string, type string, payload string, supersedes array<string>, deleted boolean, lifecycle_state string, scope string, created_at timestamp")
    edges = ([], "edge_id string, source_ref string, target_ref string, relation string, deleted boolean, lifecycle_state string")
    assert run(spark, tmp_path, "processor_proposals", atoms=atoms, edges=edges) == [("a", "b", "rel:derived_from")]
    assert run(spark, tmp_path, "unparsable_dedupe") == [("c", "b"), ("e", "d")]


def test_every_hundredth_vector_asks(spark, tmp_path):
    e = ([(100, [1.0, 0.0]), (200, [0.0, 2.0]), (7, [3.0, 0.0]), (8, None)], "vec_id bigint, embedding array<float>")
    got = run(spark, tmp_path, "cosine_topk_all", embeddings=e)
    assert [r for r in got if r[2] > 0] == [(100, 7, 1.0), (100, 100, 1.0), (200, 200, 1.0)] and len(got) == 8
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, vectors.nearest_all(df, df.where("vec_id >= 100"), "vec_id", "embedding", 1, 1, 1).collect())) == [(100, 7, 1.0), (200, 200, 1.0)]
