"""Tokenising, blank checks and the rule-based search-query rewrite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token boundaries: anything that is not a letter or a digit (Java regex and
# RE2 agree on \p{L} and \p{N}).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Leading/trailing ASCII whitespace; `trim` alone removes spaces only.
EDGE_SPACE = r"^\s+|\s+$"
SITE_OPERATOR = r"(?i)\bsite:\S*"

# Stop words dropped by `normalize_query` (our own list; the
# reference delegates the rewrite to a model).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because "
    "been before being below between both but by can could did do does doing "
    "down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out "
    "over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with would "
    "you your yours yourself yourselves please tell know "
    "le la les un une des du de et en est que qui dans pour par sur au aux "
    "der die das und ist ein eine zu den dem von mit "
    "el los las y es en un una que por para con del"
).split()


def stop_words() -> list[str]:
    return sorted(set(STOP_WORDS))


def strip_edges(col: Column | str) -> Column:
    """Remove leading and trailing ASCII whitespace (tabs included)."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, EDGE_SPACE, "")


def is_blank(col: Column | str) -> Column:
    """True for null, empty, or whitespace-only strings."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (strip_edges(c) == F.lit(""))


def tokens(col: Column | str) -> Column:
    """Lower-cased letter/digit runs, empty pieces removed, order kept."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != F.lit(""))


def collapse_spaces(col: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim both ends."""
    c = F.col(col) if isinstance(col, str) else col
    return strip_edges(F.regexp_replace(c, r"\s+", " "))


def normalize_query(col: Column | str) -> Column:
    """Rewrite a question into a concise search query, without `site:`.

    lower -> drop `site:...` -> tokens -> drop stop words -> keep the first
    occurrence of each term -> join by one space. When nothing is left the
    distinct tokens are used, and failing that the trimmed question itself.
    """
    c = F.col(col) if isinstance(col, str) else col
    toks = tokens(F.regexp_replace(c, SITE_OPERATOR, " "))
    stop = F.array(*[F.lit(w) for w in stop_words()])
    kept = F.array_join(F.array_except(toks, stop), " ")
    fallback = F.array_join(F.array_distinct(toks), " ")
    return (F.when(kept != "", kept)
             .when(fallback != "", fallback)
             .otherwise(strip_edges(c)))
