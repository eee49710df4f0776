"""Identity: canonical JSON, digests and stable ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(c: Column) -> Column:
    """Keys sorted, no spaces; null if the text is null or does not parse. Characters beyond ASCII stay as they are."""
    return F.to_json(F.try_parse_json(c))


def digest(c: Column) -> Column:
    """SHA-256 of canonical JSON text."""
    return F.sha2(c, 256)


def stable_id(prefix: str, canonical: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(digest(canonical), 1, 20))


def pair_list(*cols: Column) -> Column:
    """A JSON list of plain strings, canonical as long as they need no escapes."""
    return F.concat(F.lit('["'), F.concat_ws('","', *cols), F.lit('"]'))
