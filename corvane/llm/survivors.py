"""Problem 5: the best representative of each group of duplicate records, built field by field.

Every usable value of a field is a claim by a source (the tenant that wrote the record). A latent two-sided model
tells true values from false ones: a source has a sensitivity (it states what is true) and a specificity (it does
not state what is false), both inferred by expectation-maximisation over all groups. Several values of one field
can be judged true and are all retained: fused_values().

The model never crosses the values of a group with its sources: a source that states another value adds a term
that depends on the group alone, so two sums, by group and by value, give every probability.

survivors() names the record to take each field from by a fixed precedence of confidence, time and id. That order is
total, so no probability could change its choice, and the model is not run for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.records import confidence, stripped
from corvane.session import Workspace

FIELDS = ("subject", "predicate", "value", "unit", "claim", "note")
PRIOR, ROUNDS, CLOSE, WEIGHT = 0.5, 40, 1e-4, 4.0  # prior of a value, rounds at most, change that ends them, weight of the start values


def _records(atoms: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(dedupe_key, atom_id, source, conf, at, f array of stripped values): live records with a key that parse."""
    p = F.from_json("payload", ", ".join(f"{f} string" for f in fields) + ", retention struct<deduplication_key:string>, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = atoms.where(~F.coalesce(F.col("deleted"), F.lit(False)) & F.col("id").isNotNull()).select("id", "updated_at", confidence().alias("conf"), F.coalesce(F.get_json_object("scope", "$.tenant"), F.lit("")).alias("source"), p.alias("p"))
    rows = rows.where(F.col("p._corrupt_record").isNull() & F.col("p.retention.deduplication_key").isNotNull())
    return rows.select(F.col("p.retention.deduplication_key").alias("dedupe_key"), F.col("id").alias("atom_id"), "source", "conf", F.col("updated_at").alias("at"), F.array(*[F.struct(F.lit(f).alias("field_name"), stripped(F.col(f"p.{f}")).alias("value")) for f in fields]).alias("f"))


def _precedence() -> Column:
    """Least first: higher confidence, then later time (none is oldest), then smaller id."""
    return F.struct((-F.col("conf")).alias("c"), F.coalesce(-F.unix_micros(F.col("at")), F.lit(2**63 - 1)).alias("t"), F.col("atom_id").alias("i"))


def truth(ws: Workspace, claims: DataFrame, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """(dedupe_key, field_name, value, p_true) of every claimed value. claims: (dedupe_key, field_name, value, source, atom_id).

    Rounds end when no source's sensitivity or specificity moves by more than `close`. A round shuffles the votes
    once, by group; what it writes is one row a source.
    """
    g = ["dedupe_key", "field_name"]
    votes = ws.save(claims.groupBy(*g, "value", "source").agg(F.countDistinct("atom_id").alias("n")), "votes")
    quality = ws.save(votes.select("source").distinct().withColumns({"sens": F.lit(0.7), "spec": F.lit(0.7)}), "quality")
    of_group = W.partitionBy(*g)

    def expect(q: DataFrame) -> tuple[DataFrame, DataFrame]:
        q = q.select("source", F.log(F.col("sens") / (1 - F.col("spec"))).alias("pos"), F.log((1 - F.col("sens")) / F.col("spec")).alias("neg"))
        v = votes.join(q, "source").repartition(*g)
        p = v.groupBy(*g, "value").agg(F.sum(F.col("n") * (F.col("pos") - F.col("neg"))).alias("own"), F.sum(F.col("n") * F.col("neg")).alias("neg"))
        z = F.lit(math.log(PRIOR / (1 - PRIOR))) + F.col("own") + F.sum("neg").over(of_group)
        return v, p.select(*g, "value", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("p_true"))

    held = lambda x: F.greatest(F.lit(0.05), F.least(F.lit(0.95), x))
    n = F.col("n")
    for _ in range(rounds):
        v, p = expect(quality)
        p = p.withColumns({"t": F.sum("p_true").over(of_group), "f": F.sum(1 - F.col("p_true")).over(of_group)})
        s = v.select(*g, "value", "source", "n").join(p, [*g, "value"]).groupBy("source")
        s = s.agg(F.sum(n * F.col("p_true")).alias("st"), F.sum(n * (1 - F.col("p_true"))).alias("sf"), F.sum(n * F.col("t")).alias("ct"), F.sum(n * F.col("f")).alias("cf"))
        nxt = s.select("source", held((F.col("st") + 0.7 * WEIGHT) / (F.col("ct") + WEIGHT)).alias("sens"), held(1 - (F.col("sf") + 0.3 * WEIGHT) / (F.col("cf") + WEIGHT)).alias("spec"))
        nxt = ws.save(nxt, "quality")
        if close:
            moved = nxt.alias("a").join(quality.alias("b"), "source").agg(F.max(F.greatest(F.abs(F.col("a.sens") - F.col("b.sens")), F.abs(F.col("a.spec") - F.col("b.spec"))))).first()[0]
            if moved is None or moved <= close:
                quality = nxt
                break
        quality = nxt
    return ws.save(expect(quality)[1], "truth")


def _claims(ws: Workspace, atoms: DataFrame, placeholders: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(records of groups of two ids or more, their usable values)."""
    rows = _records(atoms, fields)
    terms = placeholders.select(F.col("term").alias("value")).where(F.col("value").isNotNull()).distinct()
    groups = rows.groupBy("dedupe_key").agg(F.min("atom_id").alias("a"), F.max("atom_id").alias("z")).where("a <> z").select("dedupe_key")
    mine = ws.save(rows.join(groups, "dedupe_key"), "records")
    flat = mine.select("dedupe_key", "atom_id", "source", "conf", "at", F.explode("f").alias("f")).select("dedupe_key", "atom_id", "source", "conf", "at", "f.field_name", "f.value").where("value is not null and value <> ''")
    bad = terms.withColumnRenamed("value", "bad")
    return mine, ws.save(flat.join(bad, F.lower("value") == F.col("bad"), "left_anti"), "claims")


def survivors(atoms: DataFrame, placeholders: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(dedupe_key, field_name, atom_id, value), one row for each field with a usable value in a group of two or more
    record ids, and one with field_name `record`: the record with most usable fields.

    Usable is a value that, stripped of white space, is neither null, empty nor, in lower case, a placeholder
    term. Records that are deleted, do not parse or have no key are in no group; repeated rows of an id count
    once; ties go by confidence, then later updated_at (null is oldest), then smaller id.
    """
    mine, claims = _claims(Workspace(atoms.sparkSession, "survivors"), atoms, placeholders, fields)
    best = claims.groupBy("dedupe_key", "field_name").agg(F.min(F.struct(_precedence().alias("order"), F.col("value"))).alias("b"))
    best = best.select("dedupe_key", "field_name", F.col("b.order.i").alias("atom_id"), F.col("b.value").alias("value"))
    count = claims.groupBy("dedupe_key", "atom_id").agg(F.countDistinct("field_name").alias("n"))
    whole = mine.select("dedupe_key", "atom_id", "conf", "at").join(count, ["dedupe_key", "atom_id"], "left")
    whole = whole.groupBy("dedupe_key").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), _precedence().alias("order"))).alias("b"))
    whole = whole.select("dedupe_key", F.lit("record").alias("field_name"), F.col("b.order.i").alias("atom_id"), F.lit(None).cast("string").alias("value"))
    return best.unionByName(whole)


def fused_values(atoms: DataFrame, placeholders: DataFrame, fields: tuple[str, ...] = FIELDS, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """(dedupe_key, field_name, value, p_true, retained): every claimed value of a group and how likely it is true;
    retained if that is at least one half. Records and usable values as in survivors()."""
    ws = Workspace(atoms.sparkSession, "fused")
    return truth(ws, _claims(ws, atoms, placeholders, fields)[1], rounds, close).withColumn("retained", F.col("p_true") >= 0.5)
