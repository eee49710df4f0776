"""Hybrid retrieval: candidates by words and by graph, visibility with reasons, weighted score, greedy packing."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.records import confidence, parsed
from corvane.functions.scopes import scope_map
from corvane.functions.text import cue_score, first_filled, tokens
from corvane.functions.times import recency
from corvane.operators import graph, quality, scans
from corvane.session import Workspace

#: Weights of the components of a record's score; what a mode sets otherwise; the least similarity that
#: counts as a match; types and words that count as evidence against; outcomes that are failures.
WEIGHTS = {
    "direct_cue_match": 0.22, "semantic_similarity": 0.14, "edge_activation": 0.12, "recency": 0.08, "confidence": 0.12, "utility": 0.12, "salience": 0.08,
    "scope_specificity": 0.06, "goal_relevance": 0.08, "procedural_applicability": 0.04, "attention_focus": 0.14, "attention_type_boost": 0.08,
    "attention_counterevidence": 0.08, "attention_novelty": 0.05, "attention_suppression_penalty": -0.20, "contradiction_penalty": -0.30,
    "staleness_penalty": -0.18, "redundancy_penalty": -0.15, "superseded_penalty": -0.20,
}
MODES = {
    "general": {},
    "skill_discovery": {"direct_cue_match": 0.28, "semantic_similarity": 0.30, "edge_activation": 0.24, "recency": 0.0, "utility": 0.02, "salience": 0.02, "scope_specificity": 0.02, "procedural_applicability": 0.08, "attention_focus": 0.08, "applicability_exclusion": -0.35},
    "agentic_recall": {"agency_match": 0.16, "attribution_confidence": 0.12, "correction_learning_relevance": 0.10, "over_attribution_penalty": -0.25, "omitted_counterevidence_penalty": -0.25, "ignored_failure_penalty": -0.20},
}
SIMILAR = 0.22
AGAINST_TYPES, AGAINST_WORDS = ("limitation", "self_assessment", "action_outcome"), ("failure", "correction", "blocked", "risk", "contradiction")
FAILURES = ("failure", "failed", "error", "blocked", "denied")


@dataclass(frozen=True)
class Attention:
    """What a reader attends to: words and types to favour or to hold back, a taste for the little known, and whether
    evidence against is wanted."""

    focus: tuple[str, ...] = ()
    suppress: tuple[str, ...] = ()
    boost_types: tuple[str, ...] = ()
    suppress_types: tuple[str, ...] = ()
    novelty: float = 0.0
    counterevidence: bool = False


def weights(mode: str = "general") -> dict[str, float]:
    return WEIGHTS | MODES[mode]


def _share(words: tuple[str, ...], text: Column, text_tokens: Column) -> Column:
    """The share of the words that the text has, 0.75 at least if one occurs in it."""
    words = tuple(sorted({w.lower() for w in words if w}))
    if not words:
        return F.lit(0.0)
    share = F.size(F.array_intersect(F.array(*map(F.lit, words)), text_tokens)) / len(words)
    there = functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return F.when(there, F.greatest(F.lit(0.75), share)).otherwise(share)


def _exclusion(payload: Column, cues: list[str]) -> Column:
    """The largest share, from 0.6 on, of the words of a phrase the record excludes that one cue has."""
    phrases = F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.selection_contract.{f}"), "array<string>") for f in ("exclusions",)], F.array().cast("array<string>"))
    want = [F.array_distinct(F.flatten(F.transform(tokens(F.lit(c)), lambda t: F.split(t, "_")))) for c in cues]

    def covered(p: Column) -> Column:
        words = F.array_distinct(F.filter(F.flatten(F.transform(tokens(p), lambda t: F.split(t, "_"))), lambda w: w != ""))
        best = F.greatest(F.lit(0.0), *[F.size(F.array_intersect(words, w)) / F.greatest(F.size(words), F.lit(1)) for w in want], F.lit(0.0))
        return F.when(best >= 0.6, best).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(phrases, covered)), F.lit(0.0))


def components(atoms: DataFrame, edges: DataFrame, cues: list[str], asked: dict[str, str], now: str, attention: Attention = Attention(), mode: str = "general", similarity: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(id, text, reason, direct_cue_match, semantic_similarity, ...): the score's components of every record.

    similarity: optional (id, similarity) of the records to the cues, by vectors. candidates: optional (id), the pool
    outside of which nothing is scored (lookup.candidate_pool). The components of the mode come behind the general ones.
    """
    one = atoms.dropDuplicates(["id"])
    if candidates is not None:
        one = one.join(candidates.select("id").distinct(), "id", "left_semi")
    reasons = scans.visibility_reasons(one, asked, include_conflicts=True, include_low_health=True)
    p = parsed()
    status = F.lower(F.coalesce(first_filled(*[F.get_json_object(p, f"$.{f}") for f in ("status", "outcome", "result")]), F.lit("")))
    base = one.select(
        "id", "type", "updated_at", "observed_at", "utility", "salience", "health_status", "lifecycle_state", confidence().alias("confidence"), F.size(scope_map()).alias("n_scope"),
        first_filled(F.get_json_object(p, "$.agent_id"), F.get_json_object(p, "$.subject_agent")).isNotNull().alias("agent"), status.alias("status"),
        first_filled(F.get_json_object(p, "$.correction"), F.get_json_object(p, "$.lesson")).isNotNull().alias("corrects"), _exclusion(p, cues).alias("exclusion"),
    ).join(reasons, "id").join(quality.rendered(one), "id")
    text, words = F.lower(F.coalesce("text", F.lit(""))), tokens(F.col("text"))
    against = F.when(F.col("health_status") == "contradicted", 1.0).when(F.col("type").isin(*AGAINST_TYPES), 0.6).when(F.arrays_overlap(words, F.array(*map(F.lit, AGAINST_WORDS))), 0.5).otherwise(0.0)
    base = base.withColumns(
        {
            "direct": cue_score(F.col("text"), words, cues),
            "focus": _share(attention.focus, text, words),
            "suppress": F.greatest(_share(attention.suppress, text, words), F.when(F.coalesce(F.col("type").isin(*attention.suppress_types), F.lit(False)), 1.0).otherwise(0.0)),
            "against": against if attention.counterevidence else F.lit(0.0),
        }
    )
    ws = Workspace(atoms.sparkSession, "retrieval")
    base = ws.save(base, "base")  # read for seeds and for scores
    live = graph.live_edges(edges).select("edge_id", "source_ref", "target_ref", "relation")
    if candidates is not None:
        pool = candidates.select("id").distinct()
        live = live.join(pool.withColumnRenamed("id", "source_ref"), "source_ref", "left_semi").join(pool.withColumnRenamed("id", "target_ref"), "target_ref", "left_semi")
    live = ws.save(live, "links")
    similar = similarity.select("id", "similarity") if similarity is not None else base.select("id", F.lit(0.0).alias("similarity")).limit(0)
    own = base.join(similar, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    seeds = own.where("reason is null").select(F.col("id").alias("ref"), F.greatest("direct", "focus", F.when(F.col("similarity") >= SIMILAR, F.col("similarity")).otherwise(0.0)).alias("strength")).where("strength > 0")
    spread = graph.activation(live, seeds).select(F.col("ref").alias("id"), F.col("strength").alias("edge"))
    degree = graph.degrees(live).select(F.col("ref").alias("id"), "degree")
    old = scans.supersession(edges, atoms).select(F.col("ref").alias("id"), F.lit(1.0).alias("superseded"))
    j = own.join(spread, "id", "left").join(degree, "id", "left").join(old, "id", "left").withColumn("edge", F.coalesce("edge", F.lit(0.0)))
    signal = F.greatest("direct", "focus", 0.5 * F.col("edge"))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    parts = {
        "direct_cue_match": F.col("direct"),
        "semantic_similarity": F.col("similarity"),
        "edge_activation": F.col("edge"),
        "recency": recency(F.coalesce("updated_at", "observed_at"), now),
        "confidence": F.col("confidence"),
        "utility": F.least(F.lit(1.0), F.coalesce("utility", F.lit(0.5))),
        "salience": F.least(F.lit(1.0), F.coalesce("salience", F.lit(0.5))),
        "scope_specificity": F.least(F.lit(1.0), F.col("n_scope") / max(1, len(asked))) if asked else F.lit(0.0),
        "goal_relevance": F.when(F.col("type").isin("goal", "commitment"), signal).otherwise(0.0),
        "procedural_applicability": F.when(F.col("type") == "procedure", signal).otherwise(0.0),
        "attention_focus": F.col("focus"),
        "attention_type_boost": flag(F.col("type").isin(*attention.boost_types)),
        "attention_counterevidence": F.col("against"),
        "attention_novelty": F.lit(attention.novelty) * (1 - F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 5)),
        "attention_suppression_penalty": F.col("suppress"),
        "contradiction_penalty": flag(F.col("health_status") == "contradicted"),
        "staleness_penalty": flag((F.col("health_status") == "stale") | (F.col("lifecycle_state") == "archived")),
        "redundancy_penalty": flag(F.col("health_status") == "merged"),
        "superseded_penalty": F.coalesce("superseded", F.lit(0.0)),
        "applicability_exclusion": F.col("exclusion"),
        "agency_match": F.when(F.col("agent"), 1.0).otherwise(0.5),
        "attribution_confidence": F.col("confidence"),
        "correction_learning_relevance": flag(F.col("corrects")),
        "over_attribution_penalty": F.lit(0.0),
        "omitted_counterevidence_penalty": F.lit(0.0),
        "ignored_failure_penalty": F.when(F.col("status").isin(*FAILURES), 0.0).otherwise(0.1),
    }
    return j.select("id", "text", "reason", *[parts[c].cast("double").alias(c) for c in weights(mode)])


def scored(parts: DataFrame, mode: str = "general") -> DataFrame:
    """(id, text, score) of the visible records that match by words, by vectors or by graph, held between 0 and 1."""
    total = sum((F.col(c) * w for c, w in weights(mode).items()), F.lit(0.0))
    hit = (F.col("direct_cue_match") > 0) | (F.col("semantic_similarity") >= SIMILAR) | (F.col("edge_activation") > 0)
    return parts.where(F.col("reason").isNull() & hit).select("id", "text", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("score"))


def pack(ranked: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """Adds packed: whether the item is taken by the greedy packer: in order, items that do not fit are skipped.

    ranked: (rank, size, ...), a bounded candidate set per group (a top-k). The running room is an aggregation over
    the group's sizes in order.
    """
    keys = [group] if group else []
    seq = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "size"))).alias("items"))
    start = F.struct(F.lit(budget).cast("bigint").alias("room"), F.array().cast("array<int>").alias("taken"))
    step = lambda s, x: F.when(x["size"] <= s["room"], F.struct((s["room"] - x["size"]).cast("bigint").alias("room"), F.concat(s["taken"], F.array(x["rank"])).alias("taken"))).otherwise(s)
    taken = seq.select(*keys, F.explode(F.aggregate("items", start, step)["taken"]).alias("rank")).withColumn("packed", F.lit(True))
    return ranked.join(taken, [*keys, "rank"], "left").withColumn("packed", F.coalesce("packed", F.lit(False)))


def packet(atoms: DataFrame, edges: DataFrame, cues: list[str], asked: dict[str, str], now: str, k: int = 64, budget: int = 4000, mode: str = "general", **options) -> DataFrame:
    """(rank, id, score, size, packed): the k best visible records for the cues and which of them fit the budget."""
    best = scored(components(atoms, edges, cues, asked, now, mode=mode, **options), mode).orderBy(F.desc(F.round("score", 9)), "id").limit(k)
    best = Workspace(atoms.sparkSession, "packet").save(best, "best")  # k rows, read twice below
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "id"))).withColumn("size", F.octet_length("text").cast("bigint"))
    return pack(ranked.select("rank", "id", F.round("score", 6).alias("score"), "size"), budget)


def omissions(parts: DataFrame) -> DataFrame:
    """(id, reason) of records that a cue meets but the reader does not get."""
    return parts.where("reason is not null and direct_cue_match > 0").select("id", "reason")
