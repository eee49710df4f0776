"""A thin façade over the operators: one object per data folder, one method per kind of question."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import archive, changes, derive, graph, hierarchy, journal, lookup, quality, references, retrieval, text_index, upkeep, views
from corvane.sources import table


class Engine:
    """Reads a data folder's tables lazily; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, now: str):
        self.spark, self.folder, self.now = spark, folder, now

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def atoms(self) -> DataFrame:
        return self.table("atoms")

    @cached_property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @cached_property
    def journal(self) -> DataFrame:
        return self.table("event_journal_entry")

    def _refs(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "ref string")

    def retrieve_atom(self, atom_id: str, scope: dict[str, str], **options) -> DataFrame:
        """(ref, reason, superseded_by, and the record's columns): one row, the record only if no reason is given."""
        found = lookup.exact_records(self._refs(atom_id), self.atoms.where(F.col("id") == atom_id), self.edges.where(F.col("target_ref") == atom_id), scope, **options)
        return found.join(self.atoms.where(F.col("id") == atom_id).dropDuplicates(["id"]).drop("superseded_by"), (F.col("ref") == F.col("id")) & F.col("reason").isNull(), "left")

    def retrieve_evidence(self, evidence_id: str, scope: dict[str, str]) -> DataFrame:
        one = self.table("evidence").where(F.col("evidence_id") == evidence_id).dropDuplicates(["evidence_id"])
        return lookup.exact_evidence(self._refs(evidence_id), one, scope).join(one, (F.col("ref") == F.col("evidence_id")) & F.col("reason").isNull(), "left")

    def classify_refs(self, refs: DataFrame, scope: dict[str, str]) -> DataFrame:
        return lookup.classify(refs, self.atoms, self.table("evidence"), scope)

    def retrieve_packet(self, cues: list[str], scope: dict[str, str], k: int = 64, budget: int = 4000, **options) -> DataFrame:
        return retrieval.packet(self.atoms, self.edges, cues, scope, self.now, k, budget, **options)

    def reading_frame(self, cues: list[str], k: int = 32) -> DataFrame:
        return derive.frame(self.atoms, self.edges, cues, list(lookup.MANDATORY), list(lookup.SUPPORTING), k, typed=True)

    def conclusions(self) -> DataFrame:
        return lookup.conclusions(self.atoms, self.edges)

    def decay(self) -> DataFrame:
        return upkeep.decay_actions(self.atoms, self.edges, self.now)

    def steward(self) -> DataFrame:
        return upkeep.steward_plan(self.atoms, self.edges)

    def capacity(self, quota: int) -> DataFrame:
        return upkeep.capacity(self.atoms, quota)

    def conversation_pages(self, after: int, limit: int) -> DataFrame:
        return views.pages(self.interaction_projection(), after, limit)

    def journal_archive(self, size: int = 512, keep_tail: int = 128, keep_segments: int = 2) -> archive.Archive:
        return archive.compact(self.journal, size, keep_tail, keep_segments)

    def lexical(self, cues: list[str], k: int) -> DataFrame:
        return text_index.best_matches(quality.rendered(self.atoms), "id", "text", cues, k)

    def memory_head(self) -> DataFrame:
        return journal.heads(self.journal)

    def series_versions(self) -> DataFrame:
        return journal.head_history(self.journal)

    def replay_graph(self) -> DataFrame:
        return changes.apply_changes(self.journal)

    def verify_journal_chain(self) -> DataFrame:
        return journal.chain_problems(self.journal)

    def verify_replay(self, stored: DataFrame) -> DataFrame:
        return journal.diff(stored, self.replay_graph().withColumnRenamed("atom_id", "id"), "id", "version")

    def analyze_provenance(self, depth: int = 64) -> DataFrame:
        return graph.ancestry(graph.live_edges(self.edges), depth, self.atoms)

    def hierarchy(self) -> DataFrame:
        return hierarchy.hierarchy(hierarchy.part_of_links(self.edges, self.table("relation_dictionary")))

    def orphan_references(self) -> DataFrame:
        refs = references.edge_references(self.edges).unionByName(references.atom_references(self.atoms))
        return references.orphan_references(refs, references.parent_keys(self.atoms, self.table("seed_atoms"), self.table("interaction_event"), self.table("evidence"), self.table("tombstones")))

    def interaction_projection(self) -> DataFrame:
        return views.projection(self.table("interaction_event"))

    def self_awareness(self, types: list[str]) -> DataFrame:
        return views.self_awareness(self.atoms, types)

    def health(self) -> DataFrame:
        return quality.integrity_summary(self.atoms, self.edges, self.table("evidence"))

    def counts(self, *by: str) -> DataFrame:
        return quality.counts_by(quality.live(self.atoms).dropDuplicates(["id"]), *by)

    def storage(self) -> DataFrame:
        """(table, bytes): file sizes of the folder's tables."""
        names = ("atoms", "edges", "evidence", "event_journal_entry", "interaction_event", "tombstones")
        parts = [self.table(n).select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size").alias("bytes")).select(F.lit(n).alias("table"), "bytes") for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
