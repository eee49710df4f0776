"""The façade answers over a data folder, and small operators keep their word on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from corvane.engine import Engine
from corvane.operators import derive, lookup, quality, upkeep
from conftest import SF


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF, "2026-07-01 00:00:00")


def test_every_question_has_an_answer(engine):
    scope = {"tenant": "tenant-0", "workspace": "ws-ledger-000"}
    refs = engine.edges.select(F.col("target_ref").alias("ref"))
    answers = [
        engine.classify_refs(refs, scope), engine.retrieve_packet(["quota"], scope, 8), engine.lexical(["quota"], 5), engine.memory_head(), engine.series_versions(), engine.replay_graph(),
        engine.analyze_provenance(), engine.hierarchy(), engine.orphan_references(), engine.interaction_projection(), engine.self_awareness(["capability"]), engine.health(), engine.counts("type"),
        engine.storage(), engine.conclusions(), engine.decay(), engine.steward(), engine.capacity(256), engine.conversation_pages(0, 5), engine.reading_frame(["quota", "ledger"], 4), engine.journal_archive(64, 16, 2).catalogue,
    ]
    assert all(a.limit(1).count() == 1 for a in answers)
    assert engine.verify_journal_chain().count() == 0
    stored = engine.replay_graph().select(F.col("atom_id").alias("id"), "version")
    assert engine.verify_replay(stored).count() == 0 and engine.verify_replay(stored.limit(0)).count() == stored.count()


def test_exact_lookups_give_the_record_or_the_reason(engine):
    rows = engine.atoms.where("lifecycle_state = 'archived' and not deleted").select("id").limit(1).collect()
    got = engine.retrieve_atom(rows[0].id, {}).collect()
    assert len(got) == 1 and got[0].reason in ("archived", "scope_hidden") and got[0].id is None
    assert [r.reason for r in engine.retrieve_atom("nowhere", {}).collect()] == ["not_found"]
    assert [r.reason for r in engine.retrieve_evidence("nowhere", {}).collect()] == ["not_found"]


def test_modes_and_scopes():
    assert lookup.lifecycle_states("deliberation", True) == ["active", "proposed", "archived"]
    assert lookup.semantic_scope({"thread": " t1 "}, {"conversation_id": "t1", "project": "global"}) == {"project_thread_id": "t1"}
    for wrong in (lambda: lookup.lifecycle_states("dreaming"), lambda: lookup.semantic_scope({"user_id": "a"}, {"human": "b"})):
        with pytest.raises(ValueError):
            wrong()


def test_hand_made_rows(spark):
    df = spark.createDataFrame([("a", "belief", '{"b": 1, "a": "x"}', '{"available": false}'), ("b", None, None, "Denied"), ("c", "t", "{", None)], "id string, type string, payload string, status string")
    assert [r[0] for r in df.orderBy("id").select(quality.record_text()).collect()] == ['a belief {"a":"x","b":1}', "b", "c t"]
    assert [r[0] for r in df.orderBy("id").select(derive.capability_unavailable(F.col("status"))).collect()] == [True, True, False]
    paths = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}, "l": [1, 2]}, "e": {}, "n": null}'), (2, "{"), (3, None)], "k int, j string")
    got = {(r.k, r.path, r.value) for r in upkeep.json_paths(paths, "k", "j").collect()}
    assert got == {(1, "a.b.c", "1"), (1, "a.l", "[1,2]"), (1, "e", "{}"), (1, "n", None)}
    text = spark.createDataFrame([('{"a": "x", "b": ["y", {"c": "z"}], "d": {"e": {"f": "w"}}, "g": "", "h": null}',)], "p string")
    assert text.select(lookup.value_text(F.col("p"))).first()[0].split() == ["x", "y", "z", "w"]


def test_windows_wrap(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "id string")
    got = [(r.id, r.wrapped) for r in upkeep.rotating_window(ids, "a", 3).orderBy("place").collect()]
    assert got == [("b", False), ("c", False), ("a", True)]
    assert [r.id for r in upkeep.rotating_window(ids, None, 2).orderBy("place").collect()] == ["a", "b"]
    assert upkeep.rotating_window(ids.limit(0), "a", 2).count() == 0
