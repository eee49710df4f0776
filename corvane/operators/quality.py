"""Data quality: integrity counts, duplicates, clusters, contradictions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.ids import canonical_json, digest
from corvane.functions.records import confidence, parsed, stripped
from corvane.functions.text import first_filled, normal_label, squeeze, tokens
from corvane.functions.times import seconds_since


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def integrity_summary(atoms: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: evidence references of live records and edges, how many resolve to evidence, only to a record, or to nothing."""
    refs = live(atoms).select(F.explode("evidence_refs").alias("ref")).unionAll(live(edges).select(F.explode("evidence_refs").alias("ref"))).where("ref is not null and ref <> ''")
    n = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))  # a hot ref is one row from here on
    ev = evidence.select(F.col("evidence_id").alias("ref")).distinct().withColumn("e", F.lit(True))
    at = atoms.select(F.col("id").alias("ref")).distinct().withColumn("a", F.lit(True))
    j = n.join(ev, "ref", "left").join(at, "ref", "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("refs"), total(F.col("e").isNotNull())("evidence"), total(F.col("e").isNull() & F.col("a").isNotNull())("record"), total(F.col("e").isNull() & F.col("a").isNull())("nothing"))


def confidence_histogram(edges: DataFrame, buckets: int = 5) -> DataFrame:
    b = F.least(F.floor(confidence() * buckets), F.lit(buckets - 1)).cast("int")
    return edges.select("relation", b.alias("bucket")).groupBy("relation", "bucket").agg(F.count(F.lit(1)).alias("n"))


def exact_duplicates(atoms: DataFrame) -> DataFrame:
    """(id, kept): records whose type, payload and scope are the same as an earlier one's, and that one.

    The earliest by (created_at, id) is found by an aggregation, so a group of any size is never gathered.
    """
    a = live(atoms).dropDuplicates(["id"]).select("id", "created_at", digest(F.concat_ws("\u0001", F.coalesce("type", F.lit("")), F.coalesce(canonical_json(F.col("payload")), F.col("payload"), F.lit("")), F.coalesce(canonical_json(F.col("scope")), F.lit("")))).alias("d"))
    kept = a.groupBy("d").agg(F.min(F.struct(F.coalesce("created_at", F.timestamp_micros(F.lit(0))), "id")).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", F.col("k.id").alias("kept"))
    return a.join(kept, "d").where("id <> kept").select("id", "kept")


def keep_best(rows: DataFrame, group: str, key: str, *order: str) -> DataFrame:
    """(key, kept): rows that are not the best of their group; larger is better, then the smaller key."""
    r = rows.where(F.col(group).isNotNull()).select(group, key, *order).distinct()
    best = r.groupBy(group).agg(F.max_by(key, F.struct(*order)).alias("any"), F.max(F.struct(*order)).alias("top"))
    ties = r.join(best.select(group, "top"), group).where(F.struct(*order).eqNullSafe(F.col("top"))).groupBy(group).agg(F.min(key).alias("kept"))
    return r.join(ties, group).where(F.col(key) != F.col("kept")).select(key, "kept")


def cluster_keys(atoms: DataFrame) -> DataFrame:
    """(id, cluster): subject and predicate, else name, else the first eight tokens of the payload."""
    g = lambda f: F.get_json_object(parsed(), f"$.{f}")
    sp = F.when(F.coalesce(g("subject"), F.lit("")) != "", F.when(F.coalesce(g("predicate"), F.lit("")) != "", F.concat_ws("|", F.lower(g("subject")), F.lower(g("predicate")))))
    words = F.array_join(F.slice(tokens(F.col("payload")), 1, 8), " ")
    return live(atoms).dropDuplicates(["id"]).select("id", F.coalesce(sp, F.lower(F.nullif(g("name"), F.lit(""))), words).alias("cluster"))


def clusters(keys: DataFrame) -> DataFrame:
    """(cluster, n, first_id) of clusters with two members or more."""
    return keys.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n >= 2")


def contradictions(atoms: DataFrame) -> DataFrame:
    """(type, scope, subject, predicate, n_values, n_records): one question answered in different ways."""
    g = lambda f: F.nullif(F.get_json_object("payload", f"$.{f}"), F.lit(""))
    a = live(atoms).dropDuplicates(["id"]).select("id", "type", F.coalesce(canonical_json(F.col("scope")), F.lit("{}")).alias("scope"), normal_label(g("subject")).alias("subject"), normal_label(g("predicate")).alias("predicate"), g("value").alias("value")).where("subject is not null and predicate is not null and value is not null")
    per_value = a.groupBy("type", "scope", "subject", "predicate", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("type", "scope", "subject", "predicate").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_records")).where("n_values > 1")


def rendered(atoms: DataFrame) -> DataFrame:
    """(id, text): the claim, else name, description, summary, else the whole payload; empty texts are passed over."""
    g = lambda f: F.get_json_object(parsed(), f"$.{f}")
    return atoms.dropDuplicates(["id"]).select("id", F.coalesce(first_filled(g("claim"), g("name"), g("description"), g("summary")), F.col("payload")).alias("text"))


def record_text() -> Column:
    """Id, type and canonical payload as one text."""
    return F.concat_ws(" ", "id", "type", canonical_json(F.col("payload")))


def age_buckets(atoms: DataFrame, now: str) -> DataFrame:
    days = seconds_since(F.col("created_at"), now) / 86400
    b = F.when(days.isNull(), "unknown").when(days < 1, "day").when(days < 7, "week").when(days < 30, "month").otherwise("older")
    return live(atoms).dropDuplicates(["id"]).groupBy(F.col("lifecycle_state"), b.alias("age")).agg(F.count(F.lit(1)).alias("n"))


def retention_actions(atoms: DataFrame, now: str, archived_days: int = 7, stale_days: int = 14, superseded_days: int = 7) -> DataFrame:
    """(id, action): what age alone decides, the first rule that fits."""
    days = seconds_since(F.coalesce("updated_at", "created_at"), now) / 86400
    act = F.when((F.col("lifecycle_state") == "archived") & (days >= archived_days), "delete_archived").when((F.col("lifecycle_state") == "superseded") & (days >= superseded_days), "delete_superseded").when((F.col("health_status") == "stale") & (days >= stale_days), "delete_stale")
    return live(atoms).dropDuplicates(["id"]).select("id", act.alias("action")).where("action is not null")


def eviction_order(atoms: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """The k records to give up first: unlinked, low utility, low salience, longest untouched; ties by id."""
    a = live(atoms).where("lifecycle_state = 'active'").dropDuplicates(["id"]).select("id", "utility", "salience", F.coalesce("updated_at", "created_at").alias("at"))
    j = a.join(degrees.select(F.col("ref").alias("id"), "degree"), "id", "left")
    return j.select("id", F.col("degree").isNotNull().alias("linked"), "utility", "salience", "at").orderBy("linked", F.asc_nulls_first("utility"), F.asc_nulls_first("salience"), F.asc_nulls_first("at"), "id").limit(k).select("id", "linked", "utility", "salience")


def evidence_diversity(atoms: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, sources, kinds): distinct evidence sources and source types behind each live record."""
    e = evidence.select(F.col("evidence_id").alias("ref"), "source_ref", "source_type").dropDuplicates(["ref"])
    r = live(atoms).select("id", F.explode("evidence_refs").alias("ref")).where("ref is not null").distinct()
    return r.join(e, "ref").groupBy("id").agg(F.count_distinct("source_ref").alias("sources"), F.count_distinct("source_type").alias("kinds"))


def partition_refs(atoms: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, exact, record, unresolved): each record's distinct evidence references by what answers them."""
    r = live(atoms).select("id", F.explode("evidence_refs").alias("ref")).where("ref is not null and ref <> ''").distinct()
    j = r.join(evidence.select(F.col("evidence_id").alias("ref")).distinct().withColumn("e", F.lit(1)), "ref", "left").join(atoms.select(F.col("id").alias("ref")).distinct().withColumn("a", F.lit(1)), "ref", "left")
    return j.groupBy("id").agg(F.count("e").alias("exact"), F.count_if(F.col("e").isNull() & F.col("a").isNotNull()).alias("record"), F.count_if(F.col("e").isNull() & F.col("a").isNull()).alias("unresolved"))


def reference_repairs(atoms: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record_kind, record_ref, retained_evidence_refs, moved_source_refs, moved_unresolved_refs, source_refs,
    unresolved_source_refs): records and links whose evidence_refs hold more than evidence, or a reference twice.

    Ids of records move to source_refs, what nothing answers to unresolved_source_refs, behind those that the payload
    of a record states already. Live active and proposed records, live active links.
    """
    a = live(atoms).where("lifecycle_state in ('active', 'proposed')").dropDuplicates(["id"])
    e = live(edges).where("coalesce(lifecycle_state, 'active') = 'active'").dropDuplicates(["edge_id"])
    stated = lambda f: F.from_json(F.get_json_object(parsed(), f"$.{f}"), "array<string>")
    none = F.lit(None).cast("array<string>")
    rows = a.select(F.lit("atom").alias("record_kind"), F.col("id").alias("record_ref"), "evidence_refs", stated("source_refs").alias("had"), stated("unresolved_source_refs").alias("open"))
    rows = rows.unionByName(e.select(F.lit("edge").alias("record_kind"), F.col("edge_id").alias("record_ref"), "evidence_refs", none.alias("had"), none.alias("open")))
    refs = rows.select("record_kind", "record_ref", F.posexplode("evidence_refs").alias("pos", "ref")).withColumn("ref", stripped(F.col("ref"))).where("ref <> ''")
    refs = refs.groupBy("record_kind", "record_ref", "ref").agg(F.min("pos").alias("pos"))
    j = refs.join(evidence.select(F.col("evidence_id").alias("ref")).distinct().withColumn("e", F.lit(True)), "ref", "left").join(atoms.select(F.col("id").alias("ref")).distinct().withColumn("a", F.lit(True)), "ref", "left")
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "ref")))), lambda x: x["ref"])
    parts = j.groupBy("record_kind", "record_ref").agg(part(F.col("e").isNotNull()).alias("kept"), part(F.col("e").isNull() & F.col("a").isNotNull()).alias("moved"), part(F.col("e").isNull() & F.col("a").isNull()).alias("lost"))
    empty = F.array().cast("array<string>")
    r = rows.join(parts, ["record_kind", "record_ref"], "left").withColumns({c: F.coalesce(c, empty) for c in ("evidence_refs", "kept", "moved", "lost", "had", "open")})
    both = lambda x, y: F.filter(F.array_distinct(F.concat(x, y)), lambda v: v.isNotNull() & (v != ""))
    return r.where(~F.col("kept").eqNullSafe(F.col("evidence_refs"))).select("record_kind", "record_ref", F.col("kept").alias("retained_evidence_refs"), F.col("moved").alias("moved_source_refs"), F.col("lost").alias("moved_unresolved_refs"), both("had", "moved").alias("source_refs"), both("open", "lost").alias("unresolved_source_refs"))


def cohorts(atoms: DataFrame, least: int) -> DataFrame:
    """(cohort, n, best): records of one type and tenant; the member of highest utility, ties by id."""
    a = live(atoms).dropDuplicates(["id"]).select("id", F.concat_ws("/", "type", F.get_json_object("scope", "$.tenant")).alias("cohort"), F.coalesce("utility", F.lit(0.0)).alias("u"))
    return a.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("u")).alias("u"), "id")).alias("b")).where(F.col("n") >= least).select("cohort", "n", F.col("b.id").alias("best"))


def shape_violations(atoms: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, rule): rules are (type, rule id, SQL condition over payload that must hold), all checked in one pass."""
    checks = F.array(*[F.when((F.col("type") == t) & ~F.coalesce(F.expr(cond), F.lit(False)), F.lit(rule)) for t, rule, cond in rules])
    return live(atoms).dropDuplicates(["id"]).withColumn("payload", parsed()).select("id", F.explode(F.array_compact(checks)).alias("rule"))


def required(*fields: str) -> str:
    """A condition: one of the payload fields is there and not empty."""
    return " or ".join(f"coalesce(get_json_object(payload, '$.{f}'), '') <> ''" for f in fields)


def running_novelty(rows: DataFrame, subject: str, order: list[str], item: str) -> DataFrame:
    """Adds first_seen: whether this is the subject's first row with the item, in the given order."""
    first = rows.groupBy(subject, item).agg(F.min(F.struct(*order)).alias("f"))
    return rows.join(first, [subject, item]).withColumn("first_seen", F.struct(*order) == F.col("f")).drop("f")


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact interpolating p50 and p95, and the mean."""
    return df.groupBy(group).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.avg(value).alias("mean"))


def top_per_group(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def highlights(chosen: DataFrame, atoms: DataFrame, most: int, length: int) -> DataFrame:
    """One row (sources, types, highlights) for chosen(id, place): their types and the texts of the first `most`, cut."""
    text = squeeze(F.concat(F.col("id"), F.lit(": "), F.col("text")), length, "...")
    j = chosen.join(rendered(atoms), "id").join(live(atoms).select("id", "type").dropDuplicates(["id"]), "id").select("place", "type", text.alias("x"))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "x"))))  # a chosen set is small: its size is a parameter
    return j.agg(F.count(F.lit(1)).alias("sources"), F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"), F.array_join(F.transform(first, lambda e: e["x"]), "; ").alias("highlights"))


def ontology(relations: DataFrame) -> DataFrame:
    """(canonical_relation, names, inverses, deprecated): how many names a relation goes by."""
    return relations.groupBy("canonical_relation").agg(F.count(F.lit(1)).alias("names"), F.count_if("inverse").alias("inverses"), F.count_if("deprecated").alias("deprecated"))
