"""Field-by-field survivors on hand-made groups, and the truth model on planted sources."""

import json
import random
from datetime import datetime

from corvane.llm import survivors as S
from corvane.session import Workspace

COLS = "id string, payload string, scope string, confidence struct<level:string,score:double>, updated_at timestamp, deleted boolean, value string"


def atom(i, key, conf=(None, None), at=None, deleted=False, tenant="t", **fields):
    return (i, json.dumps({**fields, "retention": {"deduplication_key": key}}), json.dumps({"tenant": tenant}), conf, at, deleted, "clash")


def fused(spark, rows):
    terms = spark.createDataFrame([("n/a",), ("tbd",), (None,)], "term string")
    df = spark.createDataFrame(rows, COLS)
    return {(r.dedupe_key, r.field_name): (r.atom_id, r.value) for r in S.survivors(df, terms).collect()}, S.fused_values(df, terms)


def test_precedence_placeholders_and_odd_rows(spark):
    t1, t2 = datetime(2025, 1, 1), datetime(2025, 2, 1)
    rows = [
        atom("a1", "k", ("high", None), t1, subject=" x ", value=5562.0, note="TBD "),
        atom("a2", "k", (None, 0.9), t2, subject="y", unit=" ", claim=None),
        atom("a3", "k", ("weird", None), t2, claim="c", note="n", subject="z", unit="u"),
        atom("a3", "k", ("weird", None), t2, claim="c", note="n", subject="z", unit="u"),
        atom("b1", "single", subject="x"),
        atom("b1", "single", subject="x"),
        atom("c1", "gone", subject="x"),
        atom("c2", "gone", subject="x", deleted=True),
        atom("d1", "none"), atom("d2", "none"),
        atom("e2", "tie", (None, None), None, subject="s"), atom("e1", "tie", ("medium", None), None, subject="s"), atom("e0", "tie", ("medium", None), t1, subject="q"),
        ("x", "{broken", None, None, None, None, None), ("y", None, None, None, None, None, None), (None, "{}", None, None, None, None, None),
    ]
    got, values = fused(spark, rows)
    seen = {(r.dedupe_key, r.field_name, r.value) for r in values.collect()}
    assert {(k, f, v) for (k, f), (_, v) in got.items() if v is not None} <= seen and all(v not in (None, "", "TBD") for _, _, v in seen)
    assert got == {
        ("k", "subject"): ("a2", "y"), ("k", "value"): ("a1", "5562.0"), ("k", "claim"): ("a3", "c"), ("k", "note"): ("a3", "n"), ("k", "unit"): ("a3", "u"), ("k", "record"): ("a3", None),
        ("none", "record"): ("d1", None), ("tie", "subject"): ("e0", "q"), ("tie", "record"): ("e0", None),
    }
    assert fused(spark, [])[0] == {}


def test_truth_model_tells_good_sources_from_bad(spark):
    rng = random.Random(8)
    claims = []
    for g in range(150):
        for s in ("good1", "good2", "good3", "bad1", "bad2"):
            right = rng.random() < (0.9 if s[0] == "g" else 0.25)
            claims.append((f"g{g}", "f", "true" if right else f"false{rng.randint(0, 1)}", s, f"{g}-{s}"))
            if s[0] == "g" and g % 10 == 0:
                claims.append((f"g{g}", "f", "also true", s, f"{g}-{s}-2"))
    p = {(r.dedupe_key, r.value): r.p_true for r in S.truth(Workspace(spark, "t"), spark.createDataFrame(claims, "dedupe_key string, field_name string, value string, source string, atom_id string")).collect()}
    assert sum(v > 0.5 for (_, x), v in p.items() if x == "true") / sum(x == "true" for _, x in p) > 0.93
    assert sum(v < 0.5 for (_, x), v in p.items() if x[:5] == "false") / sum(x[:5] == "false" for _, x in p) > 0.85
    assert sum(v > 0.5 for (_, x), v in p.items() if x == "also true") >= 13  # several values of one field are kept
