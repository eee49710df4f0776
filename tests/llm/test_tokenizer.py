"""Ids against the public library, on the corpus and on odd texts."""

import random

import pytest

from corvane.llm import tokenizer as T
from corvane.sources import table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(public):
    rng = random.Random(4)
    pick = lambda: chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x2000, 0x20FF), rng.randint(0x3040, 0x30FF), rng.randint(0x1F300, 0x1F6FF), 32, 10, 9, 0xA0, 39]))
    texts = ["".join(pick() for _ in range(rng.randint(1, 50))) for _ in range(2000)]
    texts += ["a" * 20_000, " " * 3000 + "x", "<|endoftext|> hi", "\x1c x\x85y", "1" * 3000, "ab" * 5000, "x"]
    enc = T.Encoder(T.read_ranks("byte_bpe_50k"))
    assert [enc.encode(t) for t in texts] == public(texts)
    assert all(T.merge(t.encode(), enc.ranks) for t in ("hello", " world", "zq"))


def test_merge_takes_the_leftmost_pair_of_least_rank():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aaa": 4}
    assert T.merge(b"aaaab", ranks) == [2, 2, 1]
    assert T.merge(b"aaab", ranks) == [2, 3]
    assert T.merge(b"b", ranks) == [1]


def test_corpus(spark, public):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: list(r.ids) for r in T.encode(docs, ["doc_id"]).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert got == dict(zip([i for i, _ in texts], public([t for _, t in texts])))


def test_null_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "a b", None), (2, "", "k")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in T.encode(df, ["doc_id"]).collect())
    assert got == [(0, [64, 275]), (1, []), (2, []), (2, [])]
    assert sorted(r.n_tokens for r in T.count_tokens(df, ["doc_id"]).collect()) == [0, 0, 0, 2]
    assert T.encode(df.limit(0), ["doc_id"]).count() == 0
