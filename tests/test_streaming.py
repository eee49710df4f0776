"""Streams run to the end over files and compared with their batch form."""

import json
from datetime import datetime, timedelta

import pytest

from corvane.operators.changes import ChangeFeed, apply_changes
from corvane.sources import versions
from corvane.streaming import drop_repeats, due_batches, fold_feed, windowed_counts
from corvane.streaming.feed import stream_table

JOURNAL = "event_id string, actor string, idempotency_key string, payload string, expected_versions map<string,bigint>, graph_version bigint, result_status string"


def run(q):
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def test_incremental_fold_equals_the_whole(spark, tmp_path):
    def row(g, body, key=None, actor="w", expected=None):
        return (f"e{g}", actor, key, json.dumps(body), expected or {}, g, "accepted")

    atom = lambda i, v=1: {"atom": {"id": i, "version": v}}
    after = lambda i, v: {"after": {"id": i, "version": v}}
    gone = lambda i, policy: {"before": {"id": i}, "tombstone": {"target_ref": i, "recreation_policy": policy}}
    batches = [
        [row(1, atom("a")), row(2, atom("b"), key="k1"), row(4, atom("c"), key="k2")],
        [row(5, gone("a", "block_recreate")), row(6, atom("d")), row(2, atom("b"), key="k1")],
        [row(7, atom("a")), row(8, after("b", 2), key="k1"), row(9, after("d", 2), expected={"d": 1})],
        [row(3, after("b", 5)), row(10, gone("c", "allow_recreate")), row(6, atom("d"))],
        [row(11, atom("c", 1)), row(12, after("d", 3), expected={"d": 1})],
        [row(0, atom("x"), key="k2"), row(13, atom("e"))],
        [],
        [row(14, gone("b", "allow_recreate"))],
    ]
    src = str(tmp_path / "in")
    root = str(tmp_path / "state")
    feed, so_far = ChangeFeed(spark, root, snapshot_every=3), []
    for i, rows in enumerate(batches):
        so_far += rows
        feed.apply(spark.createDataFrame(rows, JOURNAL), i + 1)
        feed.apply(spark.createDataFrame(rows, JOURNAL), i + 1)  # again after a failure
        want = sorted(map(tuple, apply_changes(spark.createDataFrame(so_far, JOURNAL)).collect()))
        assert sorted(map(tuple, feed.current().collect())) == want, i
    with pytest.raises(ValueError):
        feed.apply(spark.createDataFrame([], JOURNAL), 20)
    for rows in batches[:3]:
        spark.createDataFrame(rows, JOURNAL).coalesce(1).write.mode("append").parquet(src)
    run(fold_feed(stream_table(spark, src, 1), str(tmp_path / "s2"), str(tmp_path / "mark")))
    got = sorted(map(tuple, ChangeFeed(spark, str(tmp_path / "s2")).current().collect()))
    assert got == sorted(map(tuple, apply_changes(spark.createDataFrame(sum(batches[:3], []), JOURNAL)).collect()))
    assert not any(r[0] == "a" for r in got)


def test_repeats_windows_and_triggers(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [(f"k{i % 20}", t0 + timedelta(minutes=i % 20)) for i in range(60)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, at timestamp").coalesce(1).write.parquet(src)
    out = str(tmp_path / "out")
    run(drop_repeats(stream_table(spark, src), ["k"], "at", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "m1")).trigger(availableNow=True).start())
    assert spark.read.parquet(out).count() == 20
    q = windowed_counts(stream_table(spark, src), "at", "10 minutes", None, "1 minute").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "m2")).trigger(availableNow=True).start()
    run(q)
    assert sorted(r.n for r in spark.table("w").collect()) == [30, 30]
    many = str(tmp_path / "many")
    for i in range(5):
        spark.createDataFrame([(i,)], "n int").coalesce(1).write.mode("append").parquet(many)
    calls = []
    due_batches(stream_table(spark, many, 1), lambda df, i: calls.append((i, df.count())), 2, 1e9, lambda: 0.0, str(tmp_path / "m3"))
    assert calls == [(1, 2), (2, 2), (3, 1)]
    for i in range(3):
        spark.createDataFrame([(i,)], "n int").coalesce(1).write.mode("append").parquet(many)

    def fails(df, i):
        raise RuntimeError

    with pytest.raises(Exception):
        due_batches(stream_table(spark, many, 1), fails, 2, 1e9, lambda: 0.0, str(tmp_path / "m3"))
    due_batches(stream_table(spark, many, 1), lambda df, i: calls.append((i, df.count())), 2, 1e9, lambda: 0.0, str(tmp_path / "m3"))
    assert sum(n for _, n in calls) == 8 and calls[3][0] == 4


def test_versions_and_json_lines(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "a int")
    assert versions.publish(df, root, 0) == 1 and versions.publish(df.union(df), root, 1) == 2
    with pytest.raises(versions.StaleVersion):
        versions.publish(df, root, 1)
    assert versions.read_version(spark, root).count() == 2 and versions.read_version(spark, root, 1).count() == 1
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2}\n')
    rows, bad = versions.read_json_lines(spark, str(p), "a int, b string")
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (2, None)] and [r.line for r in bad.collect()] == ["{broken"]
    assert versions.json_argument('{"a": 1}') == {"a": 1}


def test_workspaces_can_be_closed_and_swept(spark):
    from corvane.session import Workspace, sweep

    with Workspace(spark, "t") as ws:
        assert ws.save(spark.range(3)).count() == 3
    kept = Workspace(spark, "t")
    df = kept.save(spark.range(2))
    assert sweep(spark, 3600) == 0 and df.count() == 2
    assert sweep(spark, -10) >= 1
