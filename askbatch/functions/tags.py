"""Tags of a page, read from left to right by one native pattern.

Attributes are matched in sequence from the name of their tag, with quoted
values taken whole, so a `>` or a tag inside a value is part of the value.
Comments, scripts and styles are matched at their own place in the page, one
that is never closed up to its end. All loops are possessive: they neither
backtrack nor recurse on long pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grammar of an attribute and of a start tag's inside.
ATTR_NAME = r"[^\s/>][^\s/=>]*+"
ATTR_VALUE = r"'[^']*+'|\"[^\"]*+\"|(?!['\"])[^>\s]*+"
ATTR = rf"({ATTR_NAME})(?:\s*+=++\s*+({ATTR_VALUE}))?+"
ATTRS = rf"(?:[\s/]*+{ATTR_NAME}(?:\s*+=++\s*+(?:{ATTR_VALUE}))?+)*+[\s/]*+"
TAG_NAME = r"/?+[a-zA-Z][^\s/>]*+"
# what is dropped whole
SILENT = (rf"<!--(?:.*?-->|.*+\z)|<script(?=[\s/>]){ATTRS}>(?:.*?</script\s*+>|.*+\z)"
          rf"|<style(?=[\s/>]){ATTRS}>(?:.*?</style\s*+>|.*+\z)")
OTHER = rf"<{TAG_NAME}{ATTRS}>|<[!?][^>]*+>"
# group 1: attributes of an anchor, group 2: any other tag
ANCHORS = rf"(?is){SILENT}|<a(?=[\s/])({ATTRS})>|({OTHER})"
# group 1: name of a tag, with its slash
NAMES = rf"(?is){SILENT}|<({TAG_NAME}){ATTRS}>|<[!?][^>]*+>"
ANY_TAG = rf"(?is){OTHER}"
# marks of our own; the page's own are dropped first
MARK, END = "\x01", "\x02"
MARKS = "\x01\x02\x03\x04"


def without_marks(html: Column) -> Column:
    return F.translate(html, MARKS, "")


def anchors(html: Column) -> Column:
    """array<string>, one per `<a ...>` in page order: its attributes, END, and
    the page up to the next one."""
    marked = F.regexp_replace(without_marks(html), ANCHORS, f"{MARK}$1{END}$2")
    parts = F.split(F.replace(marked, F.lit(MARK + END), F.lit("")), MARK)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def attribute(attributes: Column, name: str) -> Column:
    """The value of the last attribute of that name, quotes removed; empty if
    it has none, null if there is no such attribute."""
    pairs = F.arrays_zip(F.regexp_extract_all(attributes, F.lit(f"(?s){ATTR}"), F.lit(1)).alias("k"),
                         F.regexp_extract_all(attributes, F.lit(f"(?s){ATTR}"), F.lit(2)).alias("v"))
    mine = F.filter(pairs, lambda p: F.lower(p["k"]) == name)
    raw = F.get(mine, F.size(mine) - 1)["v"]
    quoted = (F.length(raw) >= 2) & F.left(raw, F.lit(1)).isin("'", '"')
    return F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def bare_tags(html: Column) -> Column:
    """The page with every tag reduced to its name; comments, scripts, styles,
    declarations and attributes are gone."""
    return F.replace(F.regexp_replace(without_marks(html), NAMES, "<$1>"), F.lit("<>"), F.lit(""))
