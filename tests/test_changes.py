"""The journal fold against a plain loop, on random and on hot records."""

import json
import random

from corvane.operators import changes as C

COLS = "event_id string, event_type string, actor string, idempotency_key string, target_refs array<string>, payload string, expected_versions map<string,bigint>, graph_version bigint, result_status string, extra string"


def test_patches_compose_like_single_steps():
    rng = random.Random(7)
    for _ in range(300):
        ops = []
        for i in range(rng.randint(0, 14)):
            kind = rng.choice([C.CREATE, C.CHANGE, C.CHANGE, C.REMOVE, C.REMOVE_AND_BLOCK])
            ops.append((kind, rng.randint(1, 4), f"e{i}", rng.choice([None, None, 0, 1, 2, 3])))
        cut = sorted(rng.sample(range(len(ops) + 1), min(2, len(ops) + 1)))
        parts = [ops[: cut[0]], ops[cut[0] : cut[-1]], ops[cut[-1] :]]
        a, b, c = map(C.compose, parts)
        for state in (C.ABSENT, C.BLOCKED, (1, "x"), (2, "x"), (3, "x"), (9, "x")):
            want = state
            for op in ops:
                want = C.step(want, *op)
            assert C.compose(ops)(state) == want
            assert a.then(b).then(c)(state) == want
            assert a.then(b.then(c))(state) == want
            assert C._unpack(C._pack(a.then(b)))(C._unpack(C._pack(c))(state)) == a.then(b)(c(state))


def test_base_images_come_first():
    p = C.compose([(C.SET, 3, "base", None), (C.CHANGE, 4, "e", 3)])
    assert p(C.ABSENT) == (4, "e")


def test_version_chains_stay_compact():
    p = C.compose([(C.CHANGE, v + 1, f"e{v}", v) for v in range(1, 5000)])
    assert len(p.points) == 1 and p.points[0][:2] == (1, 4999)


def brute(rows):
    best, state = {}, {}
    for r in rows:
        if r[8] == "accepted" and r[0] is not None and r[7] is not None:
            k = ("k", r[2], r[3]) if r[3] is not None else ("e", r[0])
            if k not in best or (r[7], r[0]) < (best[k][7], best[k][0]):
                best[k] = r
    for r in sorted(best.values(), key=lambda r: (r[7], r[0])):
        try:
            p = json.loads(r[5])
        except (TypeError, ValueError):
            continue
        todo = []
        if "atom" in p:
            todo.append((p["atom"]["id"], C.CREATE, p["atom"]["version"]))
        if "after" in p:
            todo.append((p["after"]["id"], C.CHANGE, p["after"]["version"]))
        if "tombstone" in p:
            todo.append((p["tombstone"]["target_ref"], C.REMOVE if p["tombstone"]["recreation_policy"] == "allow_recreate" else C.REMOVE_AND_BLOCK, None))
        for a in p.get("projected_atoms", []):
            todo.append((a["id"], C.REMOVE if a.get("deleted") else C.CREATE if a["version"] == 1 else C.CHANGE, a["version"]))
        for i, kind, v in todo:
            x = (r[6] or {}).get(i)
            state[i] = C.step(state.get(i, C.ABSENT), kind, v, r[0], x)
    return sorted((k, *v) for k, v in state.items() if isinstance(v, tuple))


def journal(n, seed, hot=0.5):
    rng, rows = random.Random(seed), []
    for g in range(1, n + 1):
        a = "hot" if rng.random() < hot else f"a{rng.randint(0, n // 8)}"
        b, v = f"a{rng.randint(0, n // 8)}", rng.randint(1, 4)
        p = rng.choice(
            [
                {"atom": {"id": a, "version": 1}},
                {"after": {"id": a, "version": v}},
                {"after": {"id": a, "version": v + 1}, "before": {"id": a, "version": v}},
                {"projected_atoms": [{"id": a, "version": v}, {"id": b, "version": 1}]},
                {"projected_atoms": [{"id": a, "version": v, "deleted": True}]},
                {"before": {"id": a}, "tombstone": {"target_ref": a, "recreation_policy": "allow_recreate" if a == "hot" or rng.random() < 0.7 else "block"}},
                {"feedback": {}},
            ]
        )
        x = {a: rng.randint(0, 4)} if rng.random() < 0.4 else rng.choice([{}, None])
        rows.append((f"e{g}", "t", f"w{rng.randint(0, 2)}", f"k{rng.randint(0, n)}" if rng.random() < 0.5 else None, [a], json.dumps(p), x, g, rng.choice(["accepted"] * 9 + ["rejected"]), "z"))
    rows += rng.choices(rows, k=n // 10)
    rows += [("bad", "t", "w", None, None, "{broken", {}, n + 1, "accepted", None), ("nil", None, None, None, None, None, None, n + 2, "accepted", None), (None, None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def fold(spark, rows, base=None):
    df = spark.createDataFrame(rows, COLS)
    return sorted(map(tuple, C.apply_changes(df, base, fan_in=2).collect()))


def test_fold_matches_a_loop_even_if_a_record_spans_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for seed in (1, 2):
            rows = journal(900, seed)
            assert fold(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_base_and_empty_journal(spark):
    base = spark.createDataFrame([("a", 3, "e0"), ("b", 1, "e0")], "atom_id string, version bigint, event_id string")
    assert fold(spark, [], base) == [("a", 3, "e0"), ("b", 1, "e0")]
    assert fold(spark, []) == []
    row = ("e1", "t", "w", None, None, json.dumps({"after": {"id": "a", "version": 4}}), {"a": 3}, 1, "accepted", "z")
    assert fold(spark, [row], base) == [("a", 4, "e1"), ("b", 1, "e0")]
