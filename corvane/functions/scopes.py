"""Visibility predicates. A scope is a map of keys to JSON-encoded scalars; three rules exist and are not the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL = "global"


def scope_map(c: str = "scope") -> Column:
    """A JSON scope as map; null, unparsable or empty scopes are an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def request(scope: dict[str, str]) -> Column:
    items = [F.lit(x) for kv in scope.items() for x in kv]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def scope_visible(own: Column, asked: dict[str, str]) -> Column:
    """Every key of the record's scope has the request's value, or is global; an empty scope is visible to all."""
    r = request(asked)
    return F.forall(F.map_entries(own), lambda e: (e["value"] == GLOBAL) | F.coalesce(F.try_element_at(r, e["key"]) == e["value"], F.lit(False)))


def maintenance_scope_visible(own: Column, asked: dict[str, str]) -> Column:
    """Hidden only by a key both name with different values of which neither is global."""
    r = request(asked)
    return F.forall(F.map_entries(own), lambda e: F.coalesce((e["value"] == GLOBAL) | (F.try_element_at(r, e["key"]) == GLOBAL) | (F.try_element_at(r, e["key"]) == e["value"]), F.lit(True)))


def scope_applies(governing: Column, subject: Column) -> Column:
    """Every key of the governing scope has exactly the subject's value; there is no wildcard."""
    return F.forall(F.map_entries(governing), lambda e: F.coalesce(F.try_element_at(subject, e["key"]) == e["value"], F.lit(False)))


def common_scope(a: Column, b: Column) -> Column:
    """The keys on which two scopes agree."""
    return F.map_filter(a, lambda k, v: F.coalesce(F.try_element_at(b, k) == v, F.lit(False)))


def access_visible(visibility: Column, requester: str, processor: str | None = None) -> Column:
    """`all`, the requester, or the processor (also as processor:<name>) is listed; no list means all."""
    who = ["all", requester, *([processor, f"processor:{processor}"] if processor else [])]
    return F.coalesce(F.arrays_overlap(visibility, F.array(*map(F.lit, who))), F.lit(True))


def redacted(refs: Column, visible: Column) -> Column:
    """Evidence refs a reader may not see become an empty list."""
    return F.when(visible, refs).otherwise(F.array().cast("array<string>"))
