"""Consistent forms against Unicode's own normalisation, and pairs against a plain grouping."""

import random
import unicodedata

from corvane.llm import lookalike as L


def plain(text):
    s = "".join("\n" if c in "  \u0085\x0b\x0c" else c for c in text.replace("\r\n", "\n").replace("\r", "\n"))
    out = []
    for c in unicodedata.normalize("NFKD", s):
        k = unicodedata.category(c)
        if c in "\n\t":
            out.append(c)
        elif k in ("Cf", "Cc") or c in L.BLANKS or 0xFE00 <= ord(c) <= 0xFE0F:
            continue
        else:
            out.append(" " if k == "Zs" else "-" if c in L.HYPHENS else L.LOOKALIKES.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.form for r in L.unify(df, "n").collect()}
    return [got.get(i) for i in range(len(texts))]


def test_forms_equal_unicode_normalisation(spark):
    rng = random.Random(2)
    marks = [chr(c) for c in range(0x300, 0x330)] + [chr(0x323), chr(0x31B)]
    pick = lambda: rng.choice([chr(rng.randint(0x20, 0x24F)), chr(rng.randint(0x370, 0x52F)), chr(rng.randint(0x1E00, 0x1EFF)), chr(rng.randint(0xFF01, 0xFF5E)), rng.choice(marks), rng.choice(marks), chr(0xAC00 + rng.randint(0, 500)), rng.choice("\u200b\u00a0\u3000\u2011\u00ad\ufeff\r\n\t")])
    texts = ["".join(pick() for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [unicodedata.normalize("NFD", t) for t in texts[:500]] + ["a" + "\u0323\u0301" * 300, "\u0301x", "", "\u1100\u1161\u11a8", "\u1161\u1100", "plain ascii \n\t"]
    got, want = forms(spark, [*texts, None]), [*map(plain, texts), None]
    bad = [(t, g, w) for t, g, w in zip([*texts, None], got, want) if g != w]
    assert not bad, min((ascii(b) for b in bad), key=len)


def test_what_matters_and_what_does_not(spark):
    same = [("caf\u00e9", "cafe\u0301"), ("\uff21\uff11", "A1"), ("p\u0430yp\u0430l", "paypal"), ("a\u00a0b", "a b"), ("re\u2011do", "re-do"), ("wo\u200brd", "word"), ("\ufb01ne", "fine"), ("\u1ec7", "e\u0323\u0302"), ("a\r\nb", "a\nb"), ("e\u200b\u0301", "\u00e9")]
    differ = [("cafe", "caf\u00e9"), ("A", "a"), ("a.", "a!"), ("a b", "ab"), ("a\u2014b", "a-b"), ("\u0451", "\u0435"), ("k\u0131r", "kir")]
    got = forms(spark, [x for p in same + differ for x in p])
    for i, (a, b) in enumerate(same + differ):
        assert (got[2 * i] == got[2 * i + 1]) == (i < len(same)), (a, b)


def test_a_larger_mapping_from_a_file(spark, tmp_path):
    (tmp_path / "confusables.txt").write_text("\ufeff# a comment\n13AA ;\t0041 ;\tMA\t# A\n2160 ; 006C ; MA\n0031 ; 006C ; MA\n05AD ; 0596 ; MA\n", encoding="utf-8")
    letters = L.confusables(str(tmp_path / "confusables.txt"))
    assert letters == {"\u13aa": "A", "\u2160": "l"}
    df = spark.createDataFrame([(1, "\u13aa1")], "n int, text string")
    assert L.unify(df, "n", letters=L.LOOKALIKES | letters).first().form == "A1"


def test_pairs(spark):
    texts = [(1, "paypal"), (2, "pаypal"), (3, "paypal"), (4, "PAYPAL"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "pay​pal"), (2, "pаypal"), (10, "x" * 50_000), (11, "x" * 50_000 + "­")]
    df = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id bigint, text string, form string")
    got = sorted(map(tuple, L.lookalike_pairs(df).collect()))
    assert got == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9), (10, 11)]
    assert L.lookalike_pairs(df.limit(0)).count() == 0
    classes = sorted(map(tuple, L.lookalike_classes(df).collect()))
    assert classes == [(1, 1, 1, 3), (2, 1, 2, 3), (3, 1, 1, 3), (9, 1, 9, 3), (10, 10, 10, 2), (11, 10, 11, 2)]


def test_long_runs_are_cut_where_no_rule_reaches(spark, monkeypatch):
    for cp in range(0x80, 0x30000):
        if unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lo") and "HANGUL" not in unicodedata.name(chr(cp), ""):
            out = L.replacement(cp)
            assert out and not unicodedata.combining(out[0]) and not L.VOWELS[0] <= ord(out[0]) <= L.TAILS[1], ascii(chr(cp))
    rng = random.Random(5)
    marks = "\u0301\u0323\u0308\u031b\u200b\u00ad\u3099"
    letters = ["\u0430\u0435\u044f\u0439", "\u6f22\u5b57\u304b\u30cf\uff8a\uff9e", "\u1100\u1161\u11a8\uac00\uac01\u3131\uffa1", "e\u00e9\u1ec7o\n\r", "\u0e01\u0e33\u0e48\u0939\u093c\u094d"]
    texts = ["".join(rng.choice(marks) if rng.random() < 0.3 else rng.choice(rng.choice(letters[: 1 + i % 5])) for _ in range(rng.randint(60, 400))) for i in range(300)]
    texts += ["\uac00" * 30_000, "\u00e9" + "\u200b" * 30_000 + "\u0301", "\u6f22" * 31 + "\u304b\u3099\u6f22"]
    want = [*map(plain, texts)]
    assert forms(spark, texts) == want
    monkeypatch.setattr(L, "FORMS_LIMIT", 0)  # forms that are too large to be broadcast
    assert forms(spark, texts) == want


def test_what_a_task_holds_does_not_grow_with_the_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "STRETCHES", 1_000, raising=False)
    df = spark.range(2_000).select(F.col("id").alias("n"), F.repeat(F.lit("caf\u00e9 \u00fcber "), 20).alias("text")).coalesce(1)  # 80,000 stretches in one split
    parts = L.unify(df, "n").groupBy(F.spark_partition_id()).count()
    assert parts.count() > 60 and parts.agg(F.max("count")).first()[0] < 100
    exploded, made = [], L._stretch_forms
    monkeypatch.setattr(L, "_stretch_forms", lambda s, points, letters: exploded.append(points) or made(s, points, letters))
    L.unify(df, "n")
    assert exploded == [4]  # f\u00e9 and a blank with \u00fc, once each
