"""Text expressions: tokens, token filters, n-grams, cue scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a search, and the form of ids that do not either.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "into", "is", "it", "of", "on", "or",
    "that", "the", "their", "this", "to", "was", "were", "will", "with", "true", "false", "none", "null", "active", "proposed", "pending",
)
REFERENCE_TOKEN = "^(atom|evt|evd|thread|cycle|repisode|curriculum|endogenous_work|kproject|agent_project)_[a-z0-9_-]{8,}$"


def tokens(c: Column) -> Column:
    """Runs of a-z, 0-9 and _ of the text in lower case; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1)), F.array().cast("array<string>"))


def is_content(t: Column) -> Column:
    """Longer than one character, no stop word, no reference id, no long hexadecimal, no version mark."""
    return (F.length(t) > 1) & ~t.isin(*STOPWORDS) & ~t.rlike(REFERENCE_TOKEN) & ~t.rlike("^[0-9a-f]{12,}$") & ~t.rlike(r"^v\d+$")


def index_tokens(c: Column) -> Column:
    """Distinct content tokens, a token with underscores also by its parts, sorted."""
    t = tokens(c)
    parts = F.flatten(F.transform(t, lambda x: F.split(x, "_")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(t, parts), is_content)))


def char_ngrams(t: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character grams of ^token$, for tokens of three characters or more."""
    framed = F.concat(F.lit("^"), t, F.lit("$"))

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)), lambda i: F.substring(framed, i, F.lit(n)))
        return F.when(F.length(framed) >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in sizes]
    return F.when(F.length(t) >= 3, F.concat(*grams)).otherwise(F.array().cast("array<string>"))


def squeeze(c: Column, limit: int, mark: str = "…") -> Column:
    """White space squeezed to single blanks, cut to `limit` characters with a mark at the end."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - len(mark))), F.lit(mark)))


def cue_score(text: Column, text_tokens: Column, cues: list[str]) -> Column:
    """1.0 if a cue occurs in the text, else the largest share of a cue's tokens that the text has; 0.0 without cues."""
    low = F.lower(F.coalesce(text, F.lit("")))
    best = [F.lit(0.0)]
    for cue in cues:
        want = F.array_distinct(tokens(F.lit(cue)))
        share = F.size(F.array_intersect(want, text_tokens)) / F.greatest(F.size(want), F.lit(1))
        best.append(F.when(low.contains(cue.lower()), F.lit(1.0)).otherwise(share))
    return F.greatest(*best) if len(best) > 1 else best[0]


def normal_label(c: Column) -> Column:
    """Lower case, outer blanks off, inner runs of blanks, - and _ as one _."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])
