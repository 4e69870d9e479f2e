"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, low chunk first. Level k holds the k-th
chunk of all ids that have one, a bitmap that says whether the id goes on, and
a rank directory (ones before each block of 512 bits). The position of an id
in the next level is the rank of its bit, so any token is read with one rank
per level and no block is decoded.

File (little-endian): magic, format version, levels, documents and ids as
unsigned 64-bit; document identifiers (signed 64-bit) and their validity
bytes; document offsets; then per level its count, chunks, bitmap padded to
512 bits and directory (the last level has no bitmap).

Documents are range-partitioned and sorted by identifier; a task encodes and
writes its documents in shards of bounded size, and the shards in order of
partition and sequence hold all documents in ascending order.

Edge cases: null text counts as empty (only the end id); null identifiers come
first; rows with equal identifiers follow each other ordered by text; an empty
table writes no file and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain, islice, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, scratch_path
from .bpe import bounded, byte_symbols, cut_stable
from .common import numpy_threads_off, whole_text
from .files import fresh_file, open_input, write_file
from .units import UnitEncoder

MAGIC = b"DACTOKEN"
VERSION = 1
CHUNK_BITS = 8
BLOCK = 512
SHARD_IDS = 8 << 20     # a shard is closed when it holds this many ids
READ_IDS = 4 << 20      # ids that a reading task takes on average


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & 0xFF).astype(np.uint8)
        rest = rest >> np.uint32(CHUNK_BITS)
        more = rest != 0
        if not more.any():
            levels.append((chunks, np.zeros(0, np.uint8), np.zeros(0, np.uint64)))
            return levels
        blocks = -(-len(chunks) // BLOCK)
        bits = np.zeros(blocks * BLOCK, bool)
        bits[:len(more)] = more
        ones = bits.reshape(blocks, BLOCK).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint64)
        levels.append((chunks, np.packbits(bits, bitorder="little"), directory))
        rest = rest[more]


def shard_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray):
    """The parts of a shard file."""
    levels = pack_levels(ids)
    yield MAGIC + np.array([VERSION, len(levels), len(doc_ids), len(ids)], "<u8").tobytes()
    yield np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    yield np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    yield np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()
    for chunks, bitmap, directory in levels:
        yield np.array([len(chunks)], "<u8").tobytes()
        yield chunks.tobytes()
        yield bitmap.tobytes()
        yield directory.astype("<u8").tobytes()


class TokenShard:
    """A shard file read into arrays; `get` and `read` need no decoding of
    anything but the tokens asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        version, n_levels, n_docs, n_ids = map(int, np.frombuffer(data, "<u8", 4, 8))
        if version != VERSION:
            raise ValueError(f"format version {version}")
        at = 40

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a
        raw, valid = take("<i8", n_docs), take(np.uint8, n_docs)
        self.doc_ids = [int(d) if v else None for d, v in zip(raw, valid, strict=True)]
        self.offsets = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for k in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks = take(np.uint8, n)
            last = k == n_levels - 1
            blocks = 0 if last else -(-n // BLOCK)
            self.levels.append((chunks, take(np.uint8, blocks * BLOCK // 8), take("<u8", blocks).astype(np.int64)))
        if at != len(data) or int(self.offsets[-1]) != n_ids:
            raise ValueError("shard is cut off or damaged")
        self.n_ids = n_ids

    @staticmethod
    def _rank(bitmap, directory, i: int) -> int:
        """Ones before bit i."""
        block = i // BLOCK
        if block == len(directory):     # one past the last bit of a full bitmap
            return int(directory[-1]) + int(np.bitwise_count(bitmap[(block - 1) * BLOCK // 8:]).sum())
        part = bitmap[block * BLOCK // 8:i // 8]
        rest = int(bitmap[i // 8]) & ((1 << (i % 8)) - 1)
        return int(directory[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def get(self, i: int) -> int:
        """Token i of the shard."""
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * CHUNK_BITS)
            if not len(bitmap) or not (bitmap[i // 8] >> (i % 8)) & 1:
                break
            i = self._rank(bitmap, directory, i)
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """Tokens [start, end) of the shard."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(k * CHUNK_BITS)
            if not len(bitmap) or start == end:
                break
            bits = np.unpackbits(bitmap[start // 8:-(-end // 8)], bitorder="little")
            more = bits[start % 8:start % 8 + end - start].astype(bool)
            start = self._rank(bitmap, directory, start)
            end = start + int(more.sum())
            where = where[more]
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> UnitEncoder:
    """Texts encoded by the tokenizers library. Its model is asked once for
    each distinct word that the pre-tokenizer cuts; units with letters on
    which Unicode versions may differ, and vocabularies with another
    pre-tokenizer, go through the whole library instead."""
    numpy_threads_off()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    model = t.model
    symbols = dict(enumerate(byte_symbols()))
    spec = json.loads(t.to_str())
    cut = spec.get("pre_tokenizer") or {}
    known_cut = (spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                 and not cut.get("add_prefix_space"))
    split = cut_stable if known_cut else lambda text: None

    def encode_words(words: list[str]) -> list[bytes]:
        lines = [w for w in words if "\n" not in w]
        shown = "\n".join(lines).encode().decode("latin-1").translate({**symbols, 10: "\n"}).split("\n") if lines else []
        if len(lines) < len(words):
            rest = iter(shown)
            shown = [w.encode().decode("latin-1").translate(symbols) if "\n" in w else next(rest) for w in words]
        tokens = list(map(model.tokenize, shown))
        raw = np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), "<u4").tobytes()
        return [raw[a:b] for a, b in pairwise((4 * np.cumsum([0, *map(len, tokens)])).tolist())]

    def encode_units(units: list[str]) -> list[bytes]:
        """Units of slices that do not split as a whole; most of them do."""
        parts = list(map(split, units))
        rest = [u for u, p in zip(units, parts, strict=True) if p is None]
        whole = iter([np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(rest, add_special_tokens=False)])
        ids = iter(encoder.words.all(list(chain.from_iterable(filter(None, parts)))))
        return [next(whole) if p is None else b"".join(islice(ids, len(p))) for p in parts]

    encoder = UnitEncoder(encode_units, {a.content: i for i, a in t.get_added_tokens_decoder().items()},
                          cut=split, encode_words=encode_words)
    return encoder


def write_token_shards(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id",
                       text_col: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write all documents in ascending order of identifier; the
    manifest, one row per shard: part, seq, path, n_docs, n_ids."""
    ordered = (docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(F.col(text_col)).alias("_text"))
               .repartitionByRange(F.col("_id").asc_nulls_first())
               .sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text"))

    def run(batches):
        encoder, end = library_encoder(vocabulary), end_id.to_bytes(4, "little")
        part, seq = TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, held = [], [], [], 0

        def close():
            path = fresh_file(folder, ".dac")
            write_file(path, shard_bytes(doc_ids, lengths, np.frombuffer(b"".join(ids), "<u4")))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path,
                                                "n_docs": len(doc_ids), "n_ids": held}])
        for b in batches:
            for some, texts in bounded(b.column(0), b.column(1)):
                for doc_id, encoded in zip(some.to_pylist(), encoder.encode(texts), strict=True):
                    ids.append(encoded + end)
                    doc_ids.append(doc_id)
                    lengths.append(len(encoded) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_ids:
                        yield close()
                        seq += 1
                        ids, doc_ids, lengths, held = [], [], [], 0
        if doc_ids:
            yield close()

    return checkpointed(ordered.mapInArrow(run, "part long, seq long, path string, n_docs long, n_ids long"),
                        "token-manifest")


def read_token_shards(manifest: DataFrame, read_ids: int = READ_IDS) -> DataFrame:
    """Documents of the shards a manifest names: doc_id, start, n_tokens, ids.
    One task reads about `read_ids` ids, at least a shard."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                with open_input(row["path"]) as f:
                    shard = TokenShard(f.read())
                at = 0
                while at < len(shard.doc_ids):      # batches of bounded size
                    end = max(at + 1, int(np.searchsorted(shard.offsets, shard.offsets[at] + (1 << 20), "right")) - 1)
                    cuts = shard.offsets[at:end + 1]
                    ids = shard.read(int(cuts[0]), int(cuts[-1])).astype("<u4").tobytes()
                    spans = ((cuts - cuts[0]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[at:end], pa.int64()),
                         pa.array(row["start"] + cuts[:-1], pa.int64()),
                         pa.array(np.diff(cuts), pa.int64()),
                         pa.array([ids[a:b] for a, b in pairwise(spans)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    at = end

    # a stated number of partitions, which adaptive execution does not merge by
    # the few bytes of the manifest
    total = manifest.agg(F.sum("n_ids")).first()[0] or 0
    return (shards.repartition(-(-total // read_ids) or 1)
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))


def token_digests(docs: DataFrame, vocabulary: str, folder: str | None = None, **kw) -> DataFrame:
    """Write the shards, read them back, and return per document from the
    files: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or scratch_path(docs.sparkSession, "token-shards")
    back = read_token_shards(write_token_shards(docs, vocabulary, folder, **kw))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
