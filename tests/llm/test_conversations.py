"""Conversations against a plain loop, also when they span several keys."""

import json
import random
from datetime import datetime, timedelta

from corvane.llm import conversations as C

ROLES = [("human", "human"), ("user", "human"), ("agent", "agent"), ("assistant", "agent"), ("tool", "tool")]
COLS = "id string, conversation_id string, sequence bigint, payload string, created_at timestamp, ingested_at timestamp, turn string"


def brute(rows):
    alias, convs = dict(ROLES), {}
    for i, c, s, p, *_ in rows:
        try:
            j = json.loads(p)
        except (TypeError, ValueError):
            j = None
        c = c if c is not None else (j or {}).get("conversation_id")
        s = s if s is not None else (int(j["sequence"]) if j and j.get("sequence") is not None else None)
        if c is not None and i is not None:
            convs.setdefault(c, {})[i] = (s, j)
    out = []
    for c, ms in convs.items():
        if any(j is None or s is None or str(j.get("role") or "").strip().lower() not in alias for s, j in ms.values()):
            continue
        seqs = sorted(s for s, _ in ms.values())
        said = {w: [s for s, j in ms.values() if alias[j["role"].strip().lower()] == w and any(x.isalnum() for x in j.get("content") or "")] for w in ("human", "agent")}
        humans = [s for s, j in ms.values() if alias[j["role"].strip().lower()] == "human"]
        fine = seqs == list(range(1, len(ms) + 1)) and said["human"] and said["agent"] and max(said["agent"]) > max(humans)
        fine = fine and all(j.get("in_reply_to") is None or (j["in_reply_to"] in ms and ms[j["in_reply_to"]][0] < s) for s, j in ms.values())
        if fine:
            out += [(c, s, i) for i, (s, _) in ms.items()]
    return sorted(out)


def corpus(n, seed, longest):
    rng, rows, t0 = random.Random(seed), [], datetime(2025, 1, 1)
    for c in range(n):
        length, cid = rng.randint(1, longest), f"c{c}"
        for s in range(1, length + 1):
            role = rng.choice(["human", "USER ", "agent"]) if s < length else "assistant"
            j = {"conversation_id": cid, "sequence": s, "role": role, "content": rng.choice(["hi", "hi", "hi", "👍"]) if rng.random() < 0.3 else "text 1"}
            if s > 1 and rng.random() < 0.4:
                j["in_reply_to"] = f"{cid}-{rng.randint(1, s - 1)}"
            row = [f"{cid}-{s}", cid, s, None, t0 + timedelta(hours=rng.randint(0, 9000)), t0, "x"]
            bad = rng.random()
            if bad < 0.01:
                j["role"] = rng.choice(["narrator", None])
            elif bad < 0.02:
                row[2] = s + 1
            elif bad < 0.03:
                j["in_reply_to"] = f"{cid}-{s + 3}"
            elif bad < 0.06:
                row[1] = None
            elif bad < 0.09:
                row[2], j["sequence"] = None, rng.choice([s, str(s)])
            row[3] = json.dumps(j)
            if rng.random() < 0.005:
                row[3] = row[3][:20]
            rows.append(tuple(row))
            if rng.random() < 0.1:
                rows.append((*row[:4], None, None, "y"))
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    got = C.rebuild(spark.createDataFrame(rows, COLS), spark.createDataFrame(ROLES, "alias string, speaker_role string"))
    return sorted((r.conversation_id, r.turn, r.event_ref) for r in got.collect())


def test_against_a_loop(spark):
    rows = corpus(60, 1, 12) + [("z", None, None, None, None, None, "n"), (None, "c0", 1, "{}", None, None, "n")]
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_conversations_over_several_keys(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    rows = corpus(25, 2, 20)
    want = brute(rows)
    assert any(s > 8 for _, s, _ in want) and run(spark, rows) == want


def test_empty(spark):
    assert run(spark, []) == []


def test_a_live_stream_emits_conversations_as_they_close(spark, tmp_path):
    t0, say = datetime(2025, 1, 1), lambda c, s, role: json.dumps({"conversation_id": c, "sequence": s, "role": role, "content": "text"})
    rows = [(f"{c}-{s}", c, s, say(c, s, "human" if s % 2 else "agent"), t0 + timedelta(days=100 * i), None, "x") for i, c in enumerate("abc") for s in (2, 1)]
    roles = spark.createDataFrame(ROLES, "alias string, speaker_role string")
    src, root = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        C.messages(spark.createDataFrame(rows, COLS), roles).coalesce(1).write.mode("append").parquet(src)
        C.emit(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), root, str(tmp_path / "mark"), "1 day").awaitTermination()
        return sorted({r.conversation_id for r in C.emitted(spark, root).collect()})

    arrive(rows[:2])
    assert arrive(rows[2:4]) == ["a"]
    assert arrive(rows[4:]) == ["a", "b"]
    more = [("a-3", "a", 3, say("a", 3, "human"), t0 + timedelta(days=300), None, "x"), ("d-1", "d", 1, say("d", 1, "human"), t0 + timedelta(days=400), None, "x")]
    assert arrive(more) == ["b", "c"]
