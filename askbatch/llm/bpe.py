"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words stand in one flat array. Each round looks
up the rank of every adjacent pair by binary search over the sorted pair keys,
takes the lowest rank of each word, merges all its occurrences from the left,
and retires words without a known pair. Words of more than LONG_WORD bytes
(text without a space) take rounds of one rank each instead: the places of a
rank are kept, and a round looks only at these and at their neighbours, so the
work stays near n log n. Decoding joins the byte strings of the ids and replaces
invalid UTF-8 as the tokenizer does.

Edge cases: null counts as empty and has no ids; a text of any length is
encoded whole, slice by slice at places where no merge can cross; strings of
special tokens in a text become their single id. Rows with equal identifiers
are encoded separately; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .units import SPACE, UnitEncoder

# Fixed value: the split pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this code point the classes of all Unicode versions agree; units with
# later letters are split by the library's own pre-tokenizer.
STABLE = re.compile("[\x00-ԯ]*")
LAST_STABLE = 0x52F
# Of these, `re` holds numbers that are no decimal digits to be word characters,
# and four control characters to be white space, so both are named.
NUMBERS = r"\d²³¹¼-¾"
NO_RANK = np.int64(1) << 40
WORDS_PER_ROUND = 1 << 14
CACHE_WORDS = 600_000       # distinct words kept per worker, beside what earlier stages left there
BATCH_BYTES = 2 << 20   # of texts encoded and decoded together
LONG_WORD = 256         # bytes; rounds over longer words look at changed places only


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def stable_ranges(kind: str) -> str:
    """The stable code points of a class as ranges, which `re` looks up in a
    table; it asks for categories one by one."""
    on = np.array([False, *(re.match(kind, chr(c)) is not None for c in range(LAST_STABLE + 1)), False])
    edges = np.flatnonzero(on[1:] != on[:-1]).tolist()
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


LETTER, NUMBER, BLANK, OTHER = map(stable_ranges, (
    rf"[^\W_{NUMBERS}]", f"[{NUMBERS}]", f"[{SPACE}]", rf"[^\w{SPACE}]|_"))
# PATTERN for texts of stable code points
STABLE_WORDS = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[{OTHER}]").replace(r"\p{L}", f"[{LETTER}]")
                          .replace(r"\p{N}", f"[{NUMBER}]").replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]"))


def cut_stable(text: str) -> list[str] | None:
    """The words of a text of stable code points, else None."""
    return STABLE_WORDS.findall(text) if STABLE.fullmatch(text) else None


def from_the_left(chosen: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (a a a) every second one, from the left; pairs
    begin at the ascending places `chosen`, whose next symbols are `after`."""
    run = np.r_[True, chosen[1:] != after[:-1]] if len(chosen) else np.zeros(0, bool)
    if run.all():
        return chosen
    first = np.flatnonzero(run)
    begin = np.repeat(first, np.diff(np.r_[first, len(chosen)]))
    return chosen[(np.arange(len(chosen)) - begin) % 2 == 0]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.whole = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that strip or need whole words are not supported")
            self.whole[t["content"]] = t["id"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.shift = int(max(vocab.values()) + 1).bit_length()
        left, right, new = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            new.append(vocab[a + b])
        keys = (np.array(left, dtype=np.int64) << self.shift) | np.array(right, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array(new, dtype=np.int64)      # by rank
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()
                                           if all(c in byte_of for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.whole.items()}
        self._library_split = None
        self.units = UnitEncoder(self.encode_units, self.whole, CACHE_WORDS, cut_stable, self.encode_words)

    def split(self, unit: str) -> list[str]:
        if (words := cut_stable(unit)) is not None:
            return words
        if self._library_split is None:
            from tokenizers import pre_tokenizers
            self._library_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [unit[a:b] for _, (a, b) in self._library_split.pre_tokenize_str(unit)]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK for unknown ones."""
        key = (left << self.shift) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty word."""
        long = np.fromiter((len(w) > LONG_WORD for w in words), bool, len(words))
        if not long.any():
            return self.merge_short(words)
        out: list = [None] * len(words)
        for some, how in ((~long, self.merge_short), (long, self.merge_long)):
            at = np.flatnonzero(some).tolist()
            for i, ids in zip(at, how([words[i] for i in at]) if at else [], strict=True):
                out[i] = ids
        return out

    def merge_long(self, words: list[bytes]) -> list[np.ndarray]:
        """By rounds of one rank, lowest first, over the places that have it.
        Symbols are linked to their neighbours; a merge changes the pairs that
        begin at its place and at the one before, no others."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = np.r_[self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)], 0]
        n = len(sym) - 1                     # place n stands for no neighbour
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[np.r_[0, ends[:-1]]] = n
        rank, alive = np.full(n + 1, NO_RANK), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def look(at: np.ndarray) -> None:
            at = at[at < n]
            at = at[after[at] < n]
            found = self.pair_ranks(sym[at], sym[after[at]])
            rank[at] = found
            known = found < NO_RANK
            at, found = at[known], found[known]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            firsts = found[np.r_[0, cuts]].tolist() if len(found) else []
            for r, a, b in zip(firsts, [0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(at[a:b])

        look(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            chosen = np.unique(np.concatenate(places.pop(r)))
            chosen = chosen[rank[chosen] == r]
            if not len(chosen):
                continue
            chosen = from_the_left(chosen, after[chosen])
            gone = after[chosen]
            sym[chosen] = self.merged[r]
            rank[chosen] = rank[gone] = NO_RANK
            alive[gone] = False
            after[chosen] = after[gone]
            before[after[chosen]] = chosen
            left = before[chosen]
            rank[left] = NO_RANK
            look(np.concatenate([left, chosen]))
        word = np.repeat(np.arange(len(words)), lengths)[alive]
        cut = np.cumsum(np.bincount(word, minlength=len(words)))
        return np.split(sym[:n][alive].astype("<u4"), cut[:-1])

    def merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """By merge rounds over all words, the lowest rank of each word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), NO_RANK)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.pair_ranks(sym[inside], sym[inside + 1])
            sizes = np.diff(np.r_[first, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            ended = best == NO_RANK
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
            take = (rank == best) & ~ended
            chosen = np.flatnonzero(take)
            chosen = from_the_left(chosen, chosen + 1)
            sym[chosen] = self.merged[rank[chosen]]
            stay = ~ended
            stay[chosen + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        return np.split(sym[order].astype("<u4"), ends[:-1])

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), WORDS_PER_ROUND):
            out += [ids.tobytes() for ids in self.merge([w.encode() for w in words[i:i + WORDS_PER_ROUND]])]
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Units of texts with other code points."""
        parts = list(map(self.split, units))
        ids = iter(self.units.words.all(list(chain.from_iterable(parts))))
        return [b"".join(islice(ids, len(p))) for p in parts]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        return self.units.encode(texts)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        joined = b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return joined.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256 and, `with_text`,
    the ids (little-endian unsigned 32-bit) and the decoded text."""
    src = docs.select(F.col(id_col).alias("_id"), whole_text(F.col(text_col)).alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()
    extra = ", ids binary, decoded string" if with_text else ""

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            for ids_, texts in bounded(b.column(0), b.column(1), BATCH_BYTES):
                n, sha, back, kept, decoded = [], [], [], [], []
                for ids in bpe.encode(texts):
                    text = bpe.decode(ids)
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_text:
                        kept.append(ids)
                        decoded.append(text)
                cols = [ids_, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    cols += [pa.array(kept, pa.binary()), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"
    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def bounded(ids: pa.Array, texts: pa.Array, size: int = 8 << 20):
    """Slices of two columns with about `size` bytes of text or one row."""
    at, n = 0, len(texts)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    while at < n:
        end = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), size, side="right")))
        yield ids.slice(at, end - at), texts.slice(at, end - at).to_pylist()
        at = end
