"""Inverted index: postings, document frequencies, ranked lexical lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import index_tokens, tokens
from corvane.functions.vectors import idf
from corvane.session import Workspace


def postings(docs: DataFrame, key: str, text: str, content_only: bool = True) -> DataFrame:
    """(key, token), distinct. content_only: stop words and ids are left out, compound tokens also by their parts."""
    t = index_tokens(F.col(text)) if content_only else F.array_distinct(tokens(F.col(text)))
    return docs.select(key, F.explode(t).alias("token")).distinct()


def frequencies(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy("token").agg(F.count_distinct(key).alias("df"))


def top_terms(index: DataFrame, key: str, terms: int) -> DataFrame:
    """Postings of the most frequent terms only: frequency descending, then token."""
    top = frequencies(index, key).orderBy(F.desc("df"), "token").limit(terms).select("token")
    return index.join(top, "token", "left_semi")


def lexical_topk(index: DataFrame, key: str, cues: list[str], k: int) -> DataFrame:
    """(key, score): sum over the cue tokens a document has of ln((N+1)/(df+1)) + 1; the k best, ties by key."""
    want = index.sparkSession.createDataFrame([(c,) for c in sorted(set(cues))], "token string")
    hit = index.join(want, "token", "left_semi")  # the cue list bounds what is read on
    df = hit.groupBy("token").agg(F.count_distinct(key).alias("df"))
    total = index.agg(F.count_distinct(key)).scalar()
    scored = hit.join(df, "token").groupBy(key).agg(F.sum(idf(total, F.col("df"))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def best_matches(docs: DataFrame, key: str, text: str, cues: list[str], k: int) -> DataFrame:
    """(key, score): lexical_topk() straight from the texts, for a few cue tokens.

    Every text is cut into tokens once; of the tokens only those that are cues, and whether there are any at all, go
    further, so the postings of the corpus are neither exploded nor shuffled.
    """
    want = F.array(*[F.lit(c) for c in sorted(set(cues))]) if cues else F.array().cast("array<string>")
    t = index_tokens(F.col(text))
    hits = docs.select(key, F.array_intersect(t, want).alias("hit"), (F.size(t) > 0).alias("any")).where("any")
    hits = Workspace(docs.sparkSession, "matches").save(hits.select(key, "hit"), "hits")
    hit = hits.where(F.size("hit") > 0).select(key, F.explode("hit").alias("token")).distinct()
    df = hit.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = hits.agg(F.count_distinct(key)).scalar()
    scored = hit.join(df, "token").groupBy(key).agg(F.sum(idf(total, F.col("df"))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def prune(index: DataFrame, key: str, records: DataFrame, lifecycle: list[str], health: list[str]) -> DataFrame:
    """Postings without those of records in the given states, deleted or gone."""
    hot = records.where(~F.coalesce(F.col("deleted"), F.lit(False)) & ~F.coalesce(F.col("lifecycle_state").isin(*lifecycle), F.lit(False)) & ~F.coalesce(F.col("health_status").isin(*health), F.lit(False)))
    return index.join(hot.select(F.col("id").alias(key)), key, "left_semi")
