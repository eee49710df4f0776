"""Ages and deadlines; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_since(c: Column, now: str) -> Column:
    """Seconds from c to now, 0 for the future, null for null."""
    return F.greatest(F.lit(0), F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(c))


def recency(c: Column, now: str, span_s: float = 2_592_000.0) -> Column:
    """1 for now, falling to 0 over the span; null counts as 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - seconds_since(c, now) / F.lit(span_s)), F.lit(0.0))
