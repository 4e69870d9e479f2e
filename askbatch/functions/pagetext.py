"""HTML -> markdown of one page, as a function of its text.

The same grammar as `tags`, `references` and the rules below, read by Python's
patterns: every pass runs over the whole page at once. Letters are folded and
spaces are told in ASCII only.
"""

from __future__ import annotations

import re
from html.entities import html5

from .references import NUMBERS, REFERENCE, REPLACEMENT
from .tags import END, MARK, MARKS, NAMES

# Markdown rules for bare tags, applied in this order.
HEAD = r"(?is)<head>.*?</head\s*>"
IMAGE = r"(?i)<img>"
SPACES = r"\s{2,}|[\t-\r]"      # what is not one space already
MARKUP_RULES = [
    (r"(?i)<h1>", "\n\n# "),
    (r"(?i)<h2>", "\n\n## "),
    (r"(?i)<h3>", "\n\n### "),
    (r"(?i)<h4>", "\n\n#### "),
    (r"(?i)<h5>", "\n\n##### "),
    (r"(?i)<h6>", "\n\n###### "),
    (r"(?i)</h[1-6]>", "\n\n"),
    (r"(?i)<br>", "\n"),
    (r"(?i)<hr>", "\n\n* * *\n\n"),
    (r"(?i)</t[dh]>", " "),
    (r"(?i)</?(?:b|strong)>", "**"),
    (r"(?i)</?(?:i|em)>", "_"),
    (r"(?i)</?(?:p|div|article|section|nav|header|footer|main|aside|table|tr|title|body|html)>", "\n\n"),
    (r"</?[A-Za-z][^>]*>", ""),
]
STRUCTURE = r"(?i)<(/?(?:ol|ul|li|pre|blockquote))>"
WHITE = " \t\n\x0b\f\r"
# a separator that ends a page stays, the spaces before it go
SEPARATORS = ("\x85", "\u2028", "\u2029")
# lines and spaces that the rules must not collapse
KEPT, LINE = "\x03", "\x04"


def _pattern(text: str) -> re.Pattern:
    return re.compile(text.replace(r"\z", r"\Z"), re.ASCII)


_names, _head, _structure = _pattern(NAMES), _pattern(HEAD), _pattern(STRUCTURE)
_image, _spaces, _blank_lines = _pattern(IMAGE), _pattern(SPACES), _pattern(r"\n{3,}")
_rules = [(_pattern(p), r) for p, r in MARKUP_RULES]
_break, _tag, _return = _pattern(r"(?i)<br>"), _pattern(r"</?[A-Za-z][^>]*>"), _pattern(r"\r\n?")
_reference = _pattern("&" + REFERENCE[1:])
_no_marks = {ord(c): None for c in MARKS}
_longest = max(len(k) for k in html5 if not k.endswith(";"))


def bare_tags(html: str) -> str:
    """The page with every tag reduced to its name, as `tags.bare_tags`."""
    if any(c in html for c in MARKS):
        html = html.translate(_no_marks)
    return _names.sub(lambda m: f"<{m[1]}>" if m[1] else "<>", html).replace("<>", "")


def _decoded(found: re.Match) -> str:
    r = found[1]
    if r[0] == "#":
        body = r.rstrip(";")
        digits, base = (body[2:], 16) if body[1] in "xX" else (body[1:], 10)
        digits = digits.lstrip("0")
        if len(digits) > 8:
            return REPLACEMENT
        code = int(digits or "0", base)
        if code in NUMBERS:
            return NUMBERS[code]
        if 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
            return REPLACEMENT
        control = code < 9 or code == 0xB or 0xE <= code <= 0x1F or 0x7F <= code <= 0x9F
        return "" if control or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE else chr(code)
    if r in html5:
        return html5[r]
    for n in range(min(_longest, len(r) - 1), 1, -1):
        if r[:n] in html5:
            return html5[r[:n]] + r[n:]
    return "&" + r


def decode_references(text: str) -> str:
    """The text with its character references decoded, as `references.decode_references`."""
    return _reference.sub(_decoded, text) if "&" in text else text


def _written(text: str) -> str:
    text = _spaces.sub(" ", _image.sub("", text))
    if "<" in text:
        for pattern, replacement in _rules:
            text = pattern.sub(replacement, text)
    return text


def _kept(text: str) -> str:
    """Text of a `pre` block: lines and spaces as they are, indented by four."""
    plain = _return.sub("\n", _tag.sub("", _break.sub("\n", text)))
    spaced = plain.replace("\t", KEPT * 4).replace(" ", KEPT)
    return ("\n" + spaced).replace("\n", LINE + KEPT * 4)


def _structured(page: str) -> str:
    """The page cut at the tags that carry structure; a stack of open lists
    says what stands before each piece."""
    first, *rest = _structure.sub(lambda m: MARK + m[1] + END, page).split(MARK)
    out, lists, quotes, pre = [first], [], 0, 0
    for x in rest:
        tag, _, text = x.partition(END)
        tag, depth = tag.lower(), len(lists)
        if tag in ("ol", "ul", "/ol", "/ul"):
            opens = tag[0] != "/"
            lead = "" if depth - (0 if opens else 1) > 0 else LINE * 2
            if opens:
                lists.append([tag, 0])
            elif lists:
                lists.pop()
        elif tag == "li":
            bullet = "* "
            if lists:
                lists[-1][1] += 1
                if lists[-1][0] == "ol":
                    bullet = f"{lists[-1][1]}. "
            lead = LINE + KEPT * 2 * max(depth - 1, 0) + bullet
        elif tag == "/li":
            lead = ""
        else:
            lead = LINE * 2
            quotes = quotes + 1 if tag == "blockquote" else max(quotes - 1, 0) if tag == "/blockquote" else quotes
            pre = pre + 1 if tag == "pre" else max(pre - 1, 0) if tag == "/pre" else pre
        if quotes:
            text = lead + (_kept(text) if pre else _written(text).replace("\n", LINE))
            out.append(text.replace(LINE, LINE + (">" + KEPT) * quotes))
        else:
            out.append(lead + (_kept(text) if pre else text))
    return "".join(out)


def _tidied(text: str) -> str:
    """No spaces around line ends, no two empty lines, none at the edges."""
    first, *rest = text.split("\n")
    if rest:
        text = "\n".join([first.rstrip(" \t"), *[line.strip(" \t") for line in rest[:-1]], rest[-1].lstrip(" \t")])
    text = _blank_lines.sub("\n\n", text).lstrip(WHITE)
    if text.endswith(SEPARATORS):
        return text[:-1].rstrip(WHITE) + text[-1]
    return text.rstrip(WHITE)


def markdown(html: str) -> str:
    """Markdown text of an HTML page."""
    page = _head.sub("", bare_tags(html))
    out = decode_references(_written(_structured(page))).replace(LINE, "\n")
    return _tidied(out).replace(KEPT, " ")
