"""Expressions over a record's envelope that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a confidence level stands for where there is no score.
LEVELS = {"low": 0.2, "low-medium": 0.35, "medium": 0.5, "medium-high": 0.75, "high": 0.9}


def confidence(c: str = "confidence") -> Column:
    """The score, else the level's value, else 0.5; a null or unknown level and a null struct count as no level."""
    by_level = F.coalesce(*[F.when(F.col(f"{c}.level") == k, F.lit(v)) for k, v in LEVELS.items()])
    return F.coalesce(F.col(f"{c}.score"), by_level, F.lit(0.5))


def parsed(c: str = "payload") -> Column:
    """The JSON text if it parses, else null: a broken payload has no fields, whatever stands ahead of the break."""
    one = F.try_parse_json(F.concat(F.lit("["), F.col(c), F.lit("]")))  # alone, the parser passes over what follows the value
    at = lambda i: F.try_variant_get(one, f"$[{i}]", "variant")
    return F.when(at(0).isNotNull() & at(1).isNull(), F.col(c))


def stripped(c: Column) -> Column:
    """Text without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
