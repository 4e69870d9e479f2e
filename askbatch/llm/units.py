"""Cutting a text into units that byte-level BPE never merges across.

A unit is an optional space with the run up to the next such space. Where no
white space stands before a space, cutting at every space is safe; other texts
are cut by a pattern that treats runs of white space as the tokenizer does.
Units repeat a lot, so each distinct one is encoded once per worker and kept
in a bounded cache. Tokens of the vocabulary that are matched as whole strings
(such as an end-of-text mark) cut the text first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice
from operator import not_
from os.path import commonprefix

# Unicode White_Space (wider classes would cut differently).
SPACE = "\t-\r \x85\xa0  -     　"
SPACE_BEFORE_SPACE = re.compile(f"[{SPACE}] ")
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SAFE_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")

SLICE_CHARS = 1 << 20       # a longer text is encoded slice by slice
CACHE_UNITS = 1_600_000   # distinct units kept per worker, some 200 bytes each
BATCH_CHARS = 4 << 20         # characters of texts encoded together


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Cut at safe places, about `size` characters apart; all but the first
    slice begin with the space they were cut at."""
    at = 0
    while len(text) - at > size:
        m = SAFE_CUT.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


class Recent:
    """A bounded cache in two generations: when the young one is full it
    becomes the old one, and what is still used moves over."""

    def __init__(self, limit: int, learn: Callable[[list[str]], list[bytes]]):
        self.limit, self.learn, self.now, self.old = limit, learn, {}, {}

    def all(self, keys: list[str]) -> list[bytes]:
        """The ids of each key; new ones are learned together."""
        if len(self.now) > self.limit // 2:
            self.old, self.now = self.now, {}
        found = list(map(self.now.get, keys))
        if None in found:
            lost = set(compress(keys, map(not_, found)))        # no ids are empty
            new = list(lost.difference(self.old))
            known = lost.difference(new)
            self.now.update(zip(known, map(self.old.__getitem__, known), strict=True))
            self.now.update(zip(new, self.learn(new) if new else [], strict=True))
            found = [ids or self.now[k] for k, ids in zip(keys, found, strict=True)]
        return found


class UnitEncoder:
    """Texts to little-endian unsigned 32-bit ids, through distinct units.

    `encode_units` turns a list of distinct units into their ids as bytes;
    `whole` maps strings that are matched as one token to their id. Slices that
    `cut` splits into the words of the tokenizer (None: it can't) are learned
    word by word through `encode_words`, which has fewer distinct ones.
    """

    def __init__(self, encode_units: Callable[[list[str]], list[bytes]], whole: dict[str, int] | None = None,
                 limit: int = CACHE_UNITS, cut: Callable[[str], list[str] | None] = lambda s: None,
                 encode_words: Callable[[list[str]], list[bytes]] | None = None):
        self.cut = cut
        self.whole = {k: v.to_bytes(4, "little") for k, v in (whole or {}).items()}
        self.mark = commonprefix(list(self.whole))      # a text without it needs no closer look
        self.split_whole = (re.compile("(" + "|".join(re.escape(k) for k in sorted(self.whole, key=len, reverse=True)) + ")")
                            if self.whole else None)
        self.spaced = Recent(limit // 2, lambda units: encode_units([" " + u for u in units]))
        self.plain = Recent(limit // 2, encode_units)
        self.words = Recent(limit, encode_words)

    def _parts(self, text: str) -> Iterator[tuple]:
        """(cache, units) pieces of a text in order, or ids as bytes."""
        if self.split_whole is not None and self.mark in text and any(k in text for k in self.whole):
            segments = self.split_whole.split(text)
        else:
            segments = [text]
        for segment in segments:
            if not segment:
                continue
            if segment in self.whole:
                yield None, self.whole[segment]
                continue
            for s in slices(segment):
                if (words := self.cut(s)) is not None:
                    yield self.words, words
                elif SPACE_BEFORE_SPACE.search(s):
                    yield self.plain, CHUNK.findall(s)
                else:
                    first, *rest = s.split(" ")
                    if first:
                        yield self.plain, [first]
                    if rest:
                        yield self.spaced, rest

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text in order; texts are taken in bounded groups."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= BATCH_CHARS):
                size += len(texts[at])
                group.append(list(self._parts(texts[at])))
                at += 1
            found = {}
            for cache in (self.words, self.spaced, self.plain):
                found[cache] = iter(cache.all(list(chain.from_iterable(units for doc in group for d, units in doc if d is cache))))
            for doc in group:
                yield b"".join(units if d is None else b"".join(islice(found[d], len(units))) for d, units in doc)
