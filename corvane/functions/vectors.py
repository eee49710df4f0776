"""Vector expressions and the hashed text encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import char_ngrams, tokens

SLOTS = 64
GRAM_WEIGHT = 0.35


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is null or zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest_all(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, rows: int = 8192, asked: int = 1024) -> DataFrame:
    """(query_id, key, sim): for each row of queries the k rows of vectors of highest cosine similarity, ties by key.

    Every query meets every vector, in blocks of about `rows` vectors and `asked` queries; a block passes on k rows a
    query. Null and zero vectors have similarity 0.
    """
    import numpy as np
    import pyarrow as pa

    n_rows, n_asked = max(1, -(-vectors.count() // rows)), max(1, -(-queries.count() // asked))
    part = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = [F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")]
    left = queries.select(part(n_asked).alias("q"), every(n_rows).alias("b"), *cols)
    right = vectors.select(part(n_rows).alias("b"), every(n_asked).alias("q"), *cols)

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        def unit(t):
            vs = t.column("v").to_pylist()
            m = np.zeros((len(vs), width))
            for i, x in enumerate(vs):
                if x:
                    m[i, : len(x)] = x
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0), t.column("id").to_numpy()

        width = max([1, *(len(x) for t in (a, b) for x in t.column("v").to_pylist() if x)])
        (x, asks), (y, ids) = unit(a), unit(b)
        out: list = [[], [], []]
        for i in range(len(asks) if len(ids) else 0):
            sim = y @ x[i]
            best = np.lexsort((ids, -sim))[:k]
            for o, z in zip(out, (np.full(len(best), asks[i]), ids[best], sim[best])):
                o.append(z)
        c = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table({"query_id": pa.array(c[0], pa.int64()), key: pa.array(c[1], pa.int64()), "sim": pa.array(c[2], pa.float64())})

    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(block, f"query_id bigint, {key} bigint, sim double")
    return found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), key))).where(F.col("n") <= k).drop("n")


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a string: SHA-256 of its JSON form modulo the number of slots (a divisor of 256)."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit('"'), key, F.lit('"')), 256), 63, 2), 16, 10).cast("int") % slots).cast("int")


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def encode(docs: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """(key, slot, weight): sparse unit vectors of texts.

    A token adds (1 + ln count) * idf to its slot, a character gram 0.35 * (1 + ln count); then the vector is
    scaled to length one. Kept as rows per slot, so no text becomes one large group; to_dense() builds arrays.
    """
    t = docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    df = t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count_distinct(key)).scalar()
    words = t.join(df, "token").select(key, slot(F.col("token")).alias("slot"), ((1 + F.log("n")) * idf(total, F.col("df"))).alias("w"))
    grams = t.select(key, F.explode(char_ngrams(F.col("token"))).alias("gram"), "n").groupBy(key, "gram").agg(F.sum("n").alias("n"))
    grams = grams.select(key, slot(F.concat(F.lit("char:"), F.col("gram"))).alias("slot"), (GRAM_WEIGHT * (1 + F.log("n"))).alias("w"))
    v = words.unionByName(grams).groupBy(key, "slot").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return v.select(key, "slot", (F.col("w") / norm).alias("weight"))
