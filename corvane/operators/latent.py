"""Latent token vectors: co-occurrence by a join in Spark, the small eigenproblem on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import cosine, idf
from corvane.operators.text_index import top_terms

TERMS, COMPONENTS = 300, 32  # bounds of what comes to the driver


def cooccurrence(index: DataFrame, key: str, terms: int = TERMS) -> DataFrame:
    """(a, b, weight), a <= b: sum over documents of idf(a) * idf(b), for the most frequent terms.

    A document holds at most `terms` of them, so a document of any length gives a bounded number of pairs.
    """
    i = top_terms(index, key, terms)
    df = i.groupBy("token").agg(F.count_distinct(key).alias("df"))
    total = i.agg(F.count_distinct(key)).scalar()
    w = i.join(df, "token").select(key, "token", idf(total, F.col("df")).alias("w"))
    per_doc = w.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("t"))
    pairs = per_doc.select(F.posexplode("t").alias("i", "x"), "t").select("x", F.explode(F.slice("t", F.col("i") + 1, F.size("t"))).alias("y"))
    return pairs.groupBy(F.col("x.token").alias("a"), F.col("y.token").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("weight"))


def token_vectors(index: DataFrame, key: str, terms: int = TERMS, components: int = COMPONENTS) -> DataFrame:
    """(token, vec): unit vectors from the leading eigenvectors of the co-occurrence matrix, scaled by sqrt(lambda).

    The matrix has at most terms x terms entries; signs are fixed by the largest component. Fewer than two terms
    give no vectors.
    """
    spark = index.sparkSession
    m = cooccurrence(index, key, terms).toPandas()
    names = sorted(set(m["a"]) | set(m["b"]))
    schema = "token string, vec array<double>"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    at = {t: i for i, t in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    ia, ib = m["a"].map(at).to_numpy(), m["b"].map(at).to_numpy()
    g[ia, ib] = g[ib, ia] = m["weight"].to_numpy()
    values, vectors = np.linalg.eigh(g)
    keep = np.argsort(-values)[:components]
    keep = keep[values[keep] > 1e-10]
    v = vectors[:, keep]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    v = v * np.sqrt(values[keep])
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return spark.createDataFrame([(t, [float(x) for x in np.round(v[i], 8)]) for t, i in at.items()], schema)


def usable(rows: DataFrame, dimensions: int) -> DataFrame:
    """(token, vec): of each token the newest build, if it is an array of so many finite numbers that are not all zero."""
    v = F.from_json("vector_json", "array<double>")
    fine = (F.col("dimensions") == dimensions) & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    t = rows.where("token is not null").select("token", "graph_version", "dimensions", v.alias("v")).select("token", F.struct("graph_version", F.when(fine, F.col("v")).alias("v")).alias("r"))
    return t.groupBy("token").agg(F.max("r").alias("r")).where("r.v is not null").select("token", F.col("r.v").alias("vec"))


def candidates(vectors: DataFrame, cue: list[float], k: int, least: float) -> DataFrame:
    """(token, sim): the k tokens most similar to a cue's vector, the cue itself left out; ties by token."""
    sim = cosine(F.col("vec"), F.array(*[F.lit(x) for x in cue]))
    same = F.col("vec") == F.array(*[F.lit(x) for x in cue])
    return vectors.where(~same).select("token", sim.alias("sim")).where(F.col("sim") >= least).orderBy(F.desc("sim"), "token").limit(k)
