"""Character references (`&amp;`, `&#233;`, `&#xE9;`) as one native expression.

The text is split at every `&`, each piece is decoded by itself and the pieces
are joined again, so every reference is read once: `&amp;lt;` gives `&lt;`. The
named references are HTML5's, taken from Python's standard table at plan time;
a name without its semicolon counts where HTML5 allows that, by the longest
name that fits.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "�"


def _c1(code: int) -> str:
    """HTML reads numbers 0x80 to 0x9F as Windows-1252."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


# numbers that stand for another character
NUMBERS = {0: REPLACEMENT, 0x0D: "\r"} | {c: _c1(c) for c in range(0x80, 0xA0)}


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, int]:
    """(all names, names that need no semicolon, longest of these); frequent
    ones first, since a map is searched from its start."""
    bare = {k: v for k, v in html5.items() if not k.endswith(";")}
    first = ["amp;", "nbsp;", "quot;", "lt;", "gt;", "copy;", "middot;", "apos;"]
    every = {k: html5[k] for k in first} | html5
    return json.dumps(every), json.dumps(bare), max(map(len, bare))


def _map(text: str) -> Column:
    return F.from_json(F.lit(text), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _number(body: Column) -> Column:
    def value(digits: Column, base: int) -> Column:
        plain = F.regexp_replace(digits, "^0+", "")
        return (F.when(plain == "", F.lit(0).cast("long")).when(F.length(plain) > 8, F.lit(0x110000).cast("long"))
                .otherwise(F.conv(plain, base, 10).cast("long")))

    is_hex = F.substring(body, 2, 1).isin("x", "X")
    code = F.when(is_hex, value(F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)", 1), 16)) \
            .otherwise(value(F.regexp_extract(body, "^#([0-9]+)", 1), 10))
    return code


def _numbered(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    noncharacter = (code.between(0xFDD0, 0xFDEF) | (code % 0x10000).isin(0xFFFE, 0xFFFF))
    control = code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F)
    return (F.when((code <= 0x9F) & F.element_at(table, code.cast("int")).isNotNull(), F.element_at(table, code.cast("int")))
            .when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(REPLACEMENT))
            .when(control | noncharacter, F.lit(""))
            .otherwise(_character(F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), 0).otherwise(code))))


def decode_references(text: Column) -> Column:
    """The text with its character references decoded (null stays null)."""
    return F.get(F.transform(F.array(text), _decode), F.lit(0))      # the text is computed once


def _decode(text: Column) -> Column:
    names, bare, longest = _tables()
    every, short = _map(names), _map(bare)
    parts = F.split(text, "&")
    # (piece, reference at its start), then (piece, reference, its number)
    split = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                        lambda p: F.struct(p.alias("p"), F.regexp_extract(p, REFERENCE, 1).alias("r")))
    coded = F.transform(split, lambda x: F.struct(
        x["p"].alias("p"), x["r"].alias("r"), F.element_at(every, x["r"]).alias("named"),
        F.when(x["r"].startswith("#"), _number(x["r"])).alias("code")))

    def decoded(x: Column) -> Column:
        r = x["r"]
        tail = F.substr(x["p"], F.length(r) + 1)
        prefixed = F.coalesce(*[
            F.when(F.length(r) > n, F.concat(F.element_at(short, F.substring(r, 1, n)), F.substr(r, F.lit(n + 1))))
            for n in range(longest, 1, -1)])
        return (F.when(x["code"].isNotNull(), F.concat(_numbered(x["code"]), tail))
                .when(x["named"].isNotNull(), F.concat(x["named"], tail))
                .when(r == "", F.concat(F.lit("&"), x["p"]))
                .otherwise(F.concat(F.coalesce(prefixed, F.concat(F.lit("&"), r)), tail)))

    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(coded, decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)
