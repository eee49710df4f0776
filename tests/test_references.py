"""Bitmaps and orphan references against plain sets."""

import random
from datetime import datetime, timedelta

import numpy as np

from corvane.functions.bitmaps import CHUNK, Bitmap
from corvane.operators import references as R


def test_bitmaps_are_sets():
    rng = np.random.default_rng(1)
    for n, m in ((0, 10), (50, 9000), (9000, 50), (30000, 30000)):
        a, b = set(rng.integers(0, CHUNK, n).tolist()), set(rng.integers(0, CHUNK, m).tolist())
        x, y = Bitmap.of(np.array(sorted(a), dtype=np.int64)), Bitmap.of(np.array(sorted(b), dtype=np.int64))
        assert set(x.and_not(y).decode().tolist()) == a - b
        assert set((x | y).decode().tolist()) == a | b
        assert len(x) == len(a)


def test_orphans_against_sets(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 16)
    rng = random.Random(5)
    t0 = datetime(2025, 1, 1)
    when = lambda: rng.choice([None] + [t0 + timedelta(hours=rng.randint(0, 3000)) for _ in range(12)])
    live = [(s, f"k{i}", R.LIVE, when()) for i in range(60) for s in (0, 1) if rng.random() < 0.7]
    live += rng.choices(live, k=5)
    gone = [(s, f"k{i}", R.GONE, None) for i in range(80) for s in (0, 1) if rng.random() < 0.3]
    refs = [("edges", rng.choice([f"r{i}", f"r{i}", None]), "f", rng.randint(0, 1), "k3" if rng.random() < 0.3 else f"k{rng.randint(0, 90)}", when()) for i in range(700)]
    parents = spark.createDataFrame(live + gone, "space int, ref string, role int, at timestamp")
    df = spark.createDataFrame(refs + refs[:20], "table_name string, row_id string, field_name string, space int, ref string, created_at timestamp")
    have = {}
    for s, k, _, at in live:
        have.setdefault((s, k), []).append(at)
    dead, want = {(s, k) for s, k, _, _ in gone}, set()
    for t, row, f, s, k, at in refs:
        p = at.strftime("%Y-%m") if at else "unknown"
        if (s, k) not in have:
            want.add((t, row, f, k, "deleted" if (s, k) in dead else "missing", p))
        elif at and None not in have[s, k] and min(have[s, k]) > at:
            want.add((t, row, f, k, "late", p))
    got = list(map(tuple, R.orphan_references(df, parents).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert R.orphan_references(df.limit(0), parents).count() == 0
    assert R.orphan_references(df, parents.limit(0)).where("reason <> 'missing'").count() == 0


def test_references_of_rows(spark):
    cols = "edge_id string, source_ref string, target_ref string, evidence_refs array<string>, created_at timestamp, deleted boolean, ref string"
    e = spark.createDataFrame([("e1", "a", None, ["x", "", None, "x"], None, False, "clash"), ("e2", "", "b", None, None, None, None), ("e3", "c", "d", ["y"], None, True, None)], cols)
    got = sorted((r.row_id, r.field_name, r.space, r.ref) for r in R.edge_references(e).collect())
    assert got == [("e1", "evidence_refs", 1, "x"), ("e1", "evidence_refs", 1, "x"), ("e1", "source_ref", 0, "a"), ("e2", "target_ref", 0, "b")]
