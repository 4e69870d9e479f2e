"""Anchors and RFC 3986 reference resolution as native expressions.

The text of an anchor runs to `</a>` or to the next anchor, which is how an
unclosed anchor ends. `<abbr href>` and `data-href` do not match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .references import decode_references
from .tags import ANY_TAG, END, anchors, attribute
from .text import EDGE_SPACE, collapse_spaces

ANCHOR_CLOSE = r"(?is)</a\s*>.*$"
UNNAMED_LINK = "Unnamed link"

# RFC 3986 appendix B, with each optional part captured together with its
# delimiter so that "absent" ('') and "present but empty" ('?') differ.
URI_PARTS = r"^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page_anchors(html: Column | str) -> Column:
    """array<struct<attrs, rest>>: one per `<a ...>`, in page order."""
    return F.transform(anchors(_col(html)), lambda x: F.struct(
        F.substring_index(x, END, 1).alias("attrs"), F.substr(x, F.instr(x, F.lit(END)) + 1).alias("rest")))


def anchor_href(attrs: Column) -> Column:
    """Value of `href`: references decoded, edges trimmed; null without one."""
    return F.regexp_replace(decode_references(attribute(attrs, "href")), EDGE_SPACE, "")


def anchor_text(rest: Column) -> Column:
    """Visible link text, whitespace collapsed; empty -> `Unnamed link`."""
    inner = F.regexp_replace(F.regexp_replace(rest, ANCHOR_CLOSE, ""), ANY_TAG, "")
    text = collapse_spaces(decode_references(inner))
    return F.when(text == "", F.lit(UNNAMED_LINK)).otherwise(text)


def _remove_dot_segments(path: Column) -> Column:
    segs = F.split(path, "/")

    def step(acc, s):
        can_pop = (F.size(acc) > 1) | ((F.size(acc) == 1) & (F.get(acc, 0) != F.lit("")))
        popped = F.when(can_pop, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return (F.when(s == ".", acc)
                 .when(s == "..", popped)
                 .otherwise(F.concat(acc, F.array(s))))

    kept = F.aggregate(segs, F.array().cast("array<string>"), step)
    last = F.get(segs, F.size(segs) - 1)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(kept, "/")


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """Absolute URL of `ref` against `base` (RFC 3986 section 5.2)."""
    b, r = _col(base), _col(ref)

    def part(c, i):
        return F.regexp_extract(c, URI_PARTS, i)

    b_scheme, b_auth, b_path, b_query = (part(b, i) for i in (1, 2, 3, 4))
    r_scheme, r_auth, r_path, r_query, r_frag = (part(r, i) for i in (1, 2, 3, 4, 5))
    # non-strict form, as in common resolvers: `http:g` against an http base
    # is relative
    r_scheme = F.when((F.lower(r_scheme) == F.lower(b_scheme)) & (r_auth == ""), F.lit("")) \
                .otherwise(r_scheme)
    merged = F.when((b_auth != "") & (b_path == ""), F.concat(F.lit("/"), r_path)) \
              .otherwise(F.concat(F.regexp_replace(b_path, "[^/]*$", ""), r_path))
    target = (
        F.when(r_scheme != "", F.concat(r_scheme, r_auth, _remove_dot_segments(r_path), r_query))
         .when(r_auth != "", F.concat(b_scheme, r_auth, _remove_dot_segments(r_path), r_query))
         .when(r_path == "", F.concat(b_scheme, b_auth, b_path,
                                      F.when(r_query != "", r_query).otherwise(b_query)))
         .when(r_path.startswith("/"), F.concat(b_scheme, b_auth, _remove_dot_segments(r_path), r_query))
         .otherwise(F.concat(b_scheme, b_auth, _remove_dot_segments(merged), r_query))
    )
    # an empty reference is the base itself, fragment included
    return F.when(r == "", b).otherwise(F.concat(target, r_frag))
