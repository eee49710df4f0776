"""Processors: functions from a window of tables to proposals, registered by name or by import path."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Window = dict[str, DataFrame]
PROPOSAL = ("proposal_id", "processor", "action", "source_ref", "target_ref", "relation", "confidence", "risk")


class Registry:
    """name -> propose(window) -> rows (action, source_ref, target_ref, relation, confidence, risk)."""

    def __init__(self):
        self._all: dict[str, Callable[[Window], DataFrame]] = {}

    def register(self, name: str, propose: Callable[[Window], DataFrame]) -> None:
        if not callable(propose):
            raise TypeError("a processor is a function of a window of tables")
        self._all[name] = propose

    def load(self, name: str, path: str) -> None:
        """path: package.module:object."""
        module, _, attribute = path.partition(":")
        self.register(name, getattr(importlib.import_module(module), attribute))

    def names(self) -> list[str]:
        return sorted(self._all)

    def run(self, window: Window, names: Iterable[str] | None = None) -> DataFrame:
        """All proposals, each with a stable id; equal proposals of several processors stay apart by name."""
        out = None
        for n in sorted(names or self._all):
            rows = self._all[n](window).withColumn("processor", F.lit(n))
            key = F.concat_ws("|", "processor", "action", "source_ref", "relation", "target_ref")
            rows = rows.withColumn("proposal_id", F.concat(F.lit("prop_"), F.substring(F.sha2(key, 256), 1, 20))).select(*PROPOSAL)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no processor selected")
        return out.dropDuplicates(["proposal_id"])


def committable(proposals: DataFrame) -> DataFrame:
    """Low-risk additions only."""
    return proposals.where(F.col("risk").eqNullSafe("low") & F.col("action").isin("add_atom", "add_edge"))


def confidence_level(c: Column) -> Column:
    """The level a proposal's confidence stands for."""
    return F.when(c >= 0.85, "high").when(c >= 0.7, "medium-high").when(c >= 0.45, "medium").when(c >= 0.3, "low-medium").otherwise("low")


def missing_intrinsic_edges(window: Window) -> DataFrame:
    """The built-in processor: links that records state themselves and that no edge holds."""
    from corvane.operators.graph import intrinsic_edges, live_edges

    have = live_edges(window["edges"]).select("source_ref", "target_ref", "relation")
    new = intrinsic_edges(window["atoms"]).join(have, ["source_ref", "target_ref", "relation"], "left_anti")
    return new.select(F.lit("add_edge").alias("action"), "source_ref", "target_ref", "relation", F.lit(0.9).alias("confidence"), F.lit("low").alias("risk"))
