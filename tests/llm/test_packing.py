"""Packings hold everything once, fit, and meet the bounds."""

import random

from corvane.llm import packing as P


def test_random_histograms():
    rng = random.Random(1)
    for _ in range(150):
        cap, counts = rng.choice([10, 30, 100]), {}
        for _ in range(rng.randint(1, 50)):
            s = rng.randint(1, cap)
            counts[s] = counts.get(s, 0) + rng.choice([1, 1, 2, 40])
        fit, done = P.best_fit(counts, cap), P.complete(counts, cap, 2000)
        for packing in (fit, done):
            held = {}
            for p, t in packing:
                assert sum(s * m for s, m in p) <= cap
                for s, m in p:
                    held[s] = held.get(s, 0) + m * t
            assert held == counts
        assert P.lower_bound(counts, cap) <= sum(t for _, t in done) <= sum(t for _, t in fit)


def test_completion_beats_best_fit():
    counts, cap = {6: 1, 5: 2, 4: 2, 3: 2, 2: 2}, 17
    assert sum(t for _, t in P.complete(counts, cap)) == P.lower_bound(counts, cap)
    assert P.complete({}, 10) == [] and P.complete({0: 4}, 10) == []


def test_dominated_fillings_are_left_out():
    got = list(P.fillings(10, [7, 5, 3], {7: 1, 5: 2, 3: 3}))
    assert ((7, 1), (3, 1)) in got and ((5, 2),) in got and ((5, 1), (3, 1)) not in got


def test_triplets_fill_their_containers_exactly():
    rng = random.Random(5)
    for _ in range(5):
        counts: dict = {}
        for _ in range(20):
            a = rng.randint(380, 490)
            b = rng.randint((1000 - a) // 2 - 40, (1000 - a) // 2 + 40)
            for s in (a, b, 1000 - a - b):
                counts[s] = counts.get(s, 0) + 1
        assert sum(t for _, t in P.complete(counts, 1000, 100_000)) == 20


def test_without_a_limit_the_packing_is_the_best():
    rng = random.Random(8)
    for _ in range(40):
        cap = rng.choice([10, 13, 20])
        items = [rng.randint(2, cap - 1) for _ in range(rng.randint(3, 9))]
        least = [len(items)]

        def place(i, rooms):
            if len(rooms) >= least[0]:
                return
            if i == len(items):
                least[0] = len(rooms)
                return
            for j, r in enumerate(rooms):
                if r >= items[i]:
                    place(i + 1, rooms[:j] + [r - items[i]] + rooms[j + 1 :])
            place(i + 1, [*rooms, cap - items[i]])

        place(0, [])
        counts = {s: items.count(s) for s in items}
        assert sum(t for _, t in P.complete(counts, cap, None)) == least[0]


def test_texts_in_containers(spark):
    words = random.Random(3)
    rows = [(i, " ".join("ab" for _ in range(words.randint(1, 30)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "x y " * 500), (303, "same one"), (303, "same one"), (None, "no id")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, size string")
    got = P.pack(df, 64).collect()
    room, tokens = {}, {}
    for r in got:
        room[r.container_id] = room.get(r.container_id, 0) + r.tokens
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.tokens
    n = P.count_tokens(df, ["doc_id"]).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in n} == tokens
    assert max(room.values()) <= 64 and set(room) == set(range(len(room)))
    assert len(room) <= -(-sum(room.values()) // 64) + 1
    pieces = [r for r in got if r.doc_id == 302]
    assert all(r.tokens == 64 for r in sorted(pieces, key=lambda r: r.piece)[:-1]) and len(pieces) > 1
    assert all(r.piece == 0 for r in got if r.doc_id != 302)
    assert P.pack(df.limit(0), 64).count() == 0
    both = P.pack_all(df, {"small": 64, "large": 1000})
    small = {tuple(r) for r in both.where("budget_name = 'small'").drop("budget_name").collect()}
    assert small == {tuple(r) for r in got}
    report = {r.budget_name: r for r in P.fill_report(both, {"small": 64, "large": 1000}).collect()}
    assert report["small"].containers == len(room) and report["large"].containers >= report["large"].bound
    assert 0 <= report["small"].waste < 0.2 and report["small"].pieces == len(got)
