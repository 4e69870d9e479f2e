"""Merkle manifest of a document table: leaf coordinates by bitmap rank, levels
by keyed slot arrays.

Every row is a leaf, the hash of its columns. The place of a leaf in its source
is a rank among doc_ids, found without sorting the leaves: each map task builds
compressed bitmaps of the doc_ids of a source in ranges of RANGE ids (sorted
offsets where a range is thin, bits where it is dense, counts of repeated ids
beside them), the bitmaps of a range are merged, a directory holds the number
of rows before each range, and a rank query adds the popcount below the id's
bit, from a directory of 64-bit words. Then levels shrink by FAN: a node is
keyed by (source, place div FAN) and keeps its children in an array by place
mod FAN; the hash over the array is the node. The tree over sources is built in
the same way. On the way down every node hands each child the digests left and
right of it, so a leaf's proof, and the root folded from it, need no join per
leaf and level.

A source, or one repeated doc_id, may hold a third of all rows: ranges bound the
distinct ids of a task, ranges with many repeats are dealt over salts, and rows
that share an id are numbered by counts per leaf prefix, leaf and salt.

Edge cases: a null column is `-` in the leaf; a null doc_id comes first in its
source and is never tampered with; a null source is a source of its own, the
first; rows that share a doc_id follow one another by leaf digest, equal rows
each in a place of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, fits_broadcast
from .common import ascii_lower

FAN = 16
RANGE = 1 << 15             # doc_ids of a bitmap
THIN = RANGE // 32          # fewer ids are kept as offsets
NULL_RANGE = -(1 << 62)     # before every range of a real doc_id
CROWD = 1 << 17             # rows of a rank task, about
HELD = 4096                 # bitmaps a map task holds before it hands them on
SALTS = 256


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(F.encode(text, "UTF-8")).cast("string"), F.lit(":"), text), F.lit("-"))


def document_leaf(text: Column) -> Column:
    return digest(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text))


def tampered_text(text: Column) -> Column:
    """The tampering that the manifest must notice: A-Z lower-cased."""
    return ascii_lower(text)


# --- bitmaps and ranks --------------------------------------------------------

def pack(offsets: np.ndarray) -> bytes:
    """A set of offsets below RANGE: `A` and the offsets, or `B` and the bits."""
    if len(offsets) < THIN:
        return b"A" + offsets.astype("<u2").tobytes()
    bits = np.zeros(RANGE, np.uint8)
    bits[offsets] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"A":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


class RankBitmap:
    """A merged bitmap with its popcount directory: `below(offset)` is the
    number of rows whose id has a smaller offset."""

    def __init__(self, bitmap: bytes, repeated: bytes, extra: bytes):
        bits = np.zeros(RANGE, np.uint8)
        bits[unpack(bitmap)] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.directory = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]
        self.repeated = np.frombuffer(repeated, "<u2").astype(np.int64)
        self.extra = np.r_[0, np.cumsum(np.frombuffer(extra, "<i8"))]

    def below(self, offsets: np.ndarray) -> np.ndarray:
        word, bit = offsets >> 6, (offsets & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        inside = np.bitwise_count(self.words[word] & mask).astype(np.int64)
        return self.directory[word] + inside + self.extra[np.searchsorted(self.repeated, offsets)]

    def copies(self, offsets: np.ndarray) -> np.ndarray:
        """Rows of the id at each offset."""
        at = np.searchsorted(self.repeated, offsets)
        inside = np.minimum(at, max(0, len(self.repeated) - 1))
        hit = (at < len(self.repeated)) & (self.repeated[inside] == offsets) if len(self.repeated) else np.zeros(len(at), bool)
        return 1 + np.where(hit, np.diff(self.extra)[inside] if len(self.repeated) else 0, 0)


def _counted(offsets: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """(bitmap, repeated offsets, their extra rows, rows) of weighted offsets."""
    count = np.zeros(RANGE, np.int64)
    np.add.at(count, offsets, weights)
    ids = np.flatnonzero(count)
    more = ids[count[ids] > 1]
    return (pack(ids), more.astype("<u2").tobytes(), (count[more] - 1).astype("<i8").tobytes(), int(count.sum()))


def _weighted(bitmap: bytes, repeated: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    offsets, more = unpack(bitmap), np.frombuffer(repeated, "<u2")
    weights = np.ones(len(offsets), np.int64)
    weights[np.searchsorted(offsets, more)] += np.frombuffer(extra, "<i8")
    return offsets, weights


BITMAP = "source string, range long, bitmap binary, repeated binary, extra binary, n long"


def _partial_bitmaps(leaves: DataFrame) -> DataFrame:
    """Per map task, source and range one bitmap (several if a task meets more
    than HELD of them)."""
    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        rows = [(s, r, *_counted(np.concatenate([o for o, _ in x]), np.concatenate([w for _, w in x])))
                for (s, r), x in held.items()]
        held.clear()
        if rows:
            types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                names=["source", "range", "bitmap", "repeated", "extra", "n"])

    def run(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("source").dictionary_encode()
            which = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            rng, off = b.column("range").to_numpy(), b.column("offset").to_numpy()
            order = np.lexsort((off, rng, which))
            which, rng, off = which[order], rng[order], off[order]
            cut = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (rng[1:] != rng[:-1])])
            for lo, hi in zip(cut, np.r_[cut[1:], len(off)], strict=True):
                source = None if which[lo] < 0 else names.dictionary[int(which[lo])].as_py()
                ids, n = np.unique(off[lo:hi], return_counts=True)
                held.setdefault((source, int(rng[lo])), []).append((ids, n))
            if len(held) > HELD or sum(map(len, held.values())) > 8 * HELD:
                yield from flush(held)
        yield from flush(held)

    return leaves.select("source", "range", "offset").mapInArrow(run, BITMAP)


def _merged_bitmaps(partial: DataFrame) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(RANGE, np.int64)
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("bitmap", "repeated", "extra")), strict=True):
                offsets, weights = _weighted(*x)
                count[offsets] += weights
        ids = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()),
             *[pa.array([x], t) for x, t in zip(_counted(ids, count[ids]), (pa.binary(),) * 3 + (pa.int64(),), strict=True)]],
            names=["source", "range", "bitmap", "repeated", "extra", "n"])

    # an iterator of batches: the partial bitmaps of a range are never held together
    return partial.groupBy("source", "range").applyInArrow(run, BITMAP)


def _running(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of `value` over the earlier rows of the group, by range
    partitions and a directory of their sums: no group meets in one task."""
    keyed = rows.repartitionByRange(*[F.col(c) for c in (*group, *order)]).sortWithinPartitions(*group, *order)
    numbered = checkpointed(keyed.withColumn("_at", F.monotonically_increasing_id())
                            .withColumn("_part", F.shiftright("_at", 33)), "manifest-runs")
    parts = numbered.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    by = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_p"),
                         F.coalesce(F.sum("_sum").over(by), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col("_part") == F.col("_p")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (numbered.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(bases, on).withColumn(out, F.col("_base") + F.col("_in"))
            .drop("_at", "_part", "_sum", "_base", "_in", "_p", *[f"_{c}" for c in group]))


def _places(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with `place` in their source, and (source, n): its leaves."""
    merged = checkpointed(_merged_bitmaps(_partial_bitmaps(leaves)), "manifest-bitmaps")
    placed = _running(merged, ["source"], ["range"], "n", "before")
    directory = checkpointed(placed, "manifest-directory")
    # ranges of many repeated ids are dealt over salts; there are at most
    # rows / CROWD of them, and their size is checked before a broadcast
    crowded = directory.filter(F.col("n") > CROWD).select(
        F.col("source").alias("_s"), F.col("range").alias("_r"), F.ceil(F.col("n") / CROWD).cast("int").alias("salts"))
    small = F.broadcast(crowded) if fits_broadcast(crowded) else crowded
    rows = (leaves.join(small, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")), "left")
            .withColumn("salt", F.pmod("tie", F.coalesce("salts", F.lit(1))).cast("int"))
            .select("source", "range", "salt", "offset", "doc_id", "leaf", "changed", "tie"))
    lists = directory.select(
        F.col("source").alias("d_source"), F.col("range").alias("d_range"), "bitmap", "repeated", "extra", "before",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / CROWD).cast("int"), F.lit(1)) - 1)).alias("d_salt"))

    def run(table: pa.Table, lookup: pa.Table) -> pa.Table:
        offsets = table.column("offset").to_numpy().astype(np.int64)
        if not len(offsets):
            return pa.table({c: table.column(c) for c in ("source", "doc_id", "leaf", "changed", "tie")}
                            | {"place": pa.array([], pa.int64()), "copies": pa.array([], pa.int64())})
        ranks = RankBitmap(*(lookup.column(c)[0].as_py() for c in ("bitmap", "repeated", "extra")))
        place = lookup.column("before")[0].as_py() + ranks.below(offsets)
        return pa.table({c: table.column(c) for c in ("source", "doc_id", "leaf", "changed", "tie")}
                        | {"place": pa.array(place), "copies": pa.array(ranks.copies(offsets))})

    ranked = (rows.groupBy("source", "range", "salt").cogroup(lists.groupBy("d_source", "d_range", "d_salt"))
              .applyInArrow(run, "source string, doc_id long, leaf string, changed string, tie long, place long, copies long"))
    ranked = checkpointed(ranked, "manifest-ranks")
    sizes = directory.groupBy("source").agg(F.sum("n").alias("n"))
    once = ranked.filter("copies = 1").select("source", "doc_id", "leaf", "changed", "place")
    return once.unionByName(_numbered_repeats(ranked.filter("copies > 1"))), sizes


def _numbered_repeats(rows: DataFrame) -> DataFrame:
    """Rows that share an id: their order by leaf, from counts of (leaf prefix,
    leaf, salt), so that neither an id nor a leaf meets in one task."""
    keyed = (rows.withColumn("prefix", F.substring("leaf", 1, 3))
             .withColumn("salt", F.pmod(F.xxhash64("tie"), F.lit(SALTS)).cast("int")))
    counts = keyed.groupBy("source", "place", "prefix", "leaf", "salt").agg(F.count(F.lit(1)).alias("c"))
    prefixes = counts.groupBy("source", "place", "prefix").agg(F.sum("c").alias("p"))

    def earlier(value: str, group: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))

    prefixes = prefixes.select(F.col("source").alias("p_s"), F.col("place").alias("p_p"), F.col("prefix").alias("p_x"),
                               earlier("p", ["source", "place"], ["prefix"]).alias("b1"))
    counts = counts.select("source", "place", "prefix", F.col("leaf").alias("c_leaf"), F.col("salt").alias("c_salt"),
                           earlier("c", ["source", "place", "prefix"], ["leaf", "salt"]).alias("b2"))
    base = counts.join(prefixes, F.col("source").eqNullSafe(F.col("p_s")) & (F.col("place") == F.col("p_p"))
                       & (F.col("prefix") == F.col("p_x"))).select(
        F.col("source").alias("c_s"), F.col("place").alias("c_p"), "c_leaf", "c_salt", (F.col("b1") + F.col("b2")).alias("base"))
    inner = Window.partitionBy("source", "place", "leaf", "salt").orderBy("tie")
    return (keyed.withColumn("_rn", F.row_number().over(inner) - 1)
            .join(base, F.col("source").eqNullSafe(F.col("c_s")) & (F.col("place") == F.col("c_p"))
                  & (F.col("leaf") == F.col("c_leaf")) & (F.col("salt") == F.col("c_salt")))
            .select("source", "doc_id", "leaf", "changed", (F.col("place") + F.col("base") + F.col("_rn")).alias("place")))


# --- levels -------------------------------------------------------------------

def _reduce(nodes: DataFrame, child: Column) -> DataFrame:
    """(tree, place, n, node) of the next level, each with `slots`, the array
    of its children by place mod FAN."""
    by_slot = F.map_from_entries(F.collect_list(F.struct((F.col("place") % FAN).cast("int"), child)))
    runs = (nodes.groupBy("tree", F.floor(F.col("place") / FAN).alias("place"), F.ceil(F.col("n") / FAN).alias("n"))
            .agg(by_slot.alias("_m"), F.count(F.lit(1)).cast("int").alias("_k"))
            .withColumn("slots", F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.col("_m")[i])))
    node = digest(F.array_join(F.transform("slots", lambda c: c["digest"]), ""))
    return runs.select("tree", "place", "n", "slots", node.alias("digest"))


def _levels(leaves: DataFrame, child: Column, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels above the leaves (tree, place, n, digest, ...) until every
    tree has one node, and (tree, digest) of the roots."""
    roots = leaves.filter("n = 1").select("tree", "digest")
    levels, now = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        now = checkpointed(_reduce(now.filter("n > 1"), child), name)
        levels.append(now)
        roots = roots.unionByName(now.filter("n = 1").select("tree", "digest"))
        child, most = F.struct("digest"), -(-most // FAN)
    return levels, roots


STEP = "array<struct<left: string, right: string>>"


def _descend(levels: list[DataFrame], start: DataFrame, name: str) -> DataFrame:
    """(tree, child, path): every leaf of the trees with the digests left and
    right of it, level by level upwards. `start` has the path above each root
    (tree, path); trees of a single leaf are not in it."""
    paths = None
    for i, level in enumerate(reversed(levels)):
        top = level.filter("n = 1").join(start, "tree").select("tree", "place", "slots", "path")
        here = top
        if paths is not None:
            here = top.unionByName(level.filter("n > 1").join(paths, ["tree", "place"])
                                   .select("tree", "place", "slots", "path"))
        side = F.transform("slots", lambda c: c["digest"])
        down = here.withColumn("_d", side).select(
            "tree", (F.col("place") * FAN).alias("_first"), "path", "_d", F.posexplode("slots").alias("_i", "child"))
        step = F.struct(F.array_join(F.slice("_d", F.lit(1), F.col("_i")), "").alias("left"),
                        F.array_join(F.slice("_d", F.col("_i") + 2, F.lit(FAN)), "").alias("right"))
        paths = down.select("tree", (F.col("_first") + F.col("_i")).alias("place"), "child",
                            F.concat(F.array(step), "path").alias("path"))
        if i < len(levels) - 1:
            paths = checkpointed(paths.drop("child"), name)
    return paths


def _fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def manifest(documents: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. For
    rows where `changed` holds, the root is folded from the leaf of the
    tampered text (default: nowhere)."""
    touched = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    doc_id = F.col("doc_id").cast("long")
    leaves = checkpointed(documents.select(
        F.col("source").cast("string").alias("source"), doc_id.alias("doc_id"),
        document_leaf(F.col("text")).alias("leaf"),
        F.when(touched, document_leaf(tampered_text(F.col("text")))).alias("changed"),
        F.when(doc_id.isNull(), NULL_RANGE).otherwise(F.shiftright(doc_id, 15)).cast("long").alias("range"),
        F.when(doc_id.isNull(), 0).otherwise(doc_id.bitwiseAND(F.lit(RANGE - 1).cast("long"))).cast("int").alias("offset"),
        F.monotonically_increasing_id().alias("tie")), "manifest-leaves")
    placed, sizes = _places(leaves)
    # sources by their bytes, null first: places without one sorted task
    ordered = checkpointed(_running(sizes.withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0)),
                                    ["all"], ["source"], "one", "rank"), "manifest-sources")
    n_sources = ordered.count()
    numbered = ordered.select("source", F.col("rank").alias("tree"), "n")
    leaf_nodes = (placed.withColumnRenamed("source", "_s")
                  .join(numbered, F.col("_s").eqNullSafe(F.col("source")))
                  .select("tree", "place", "n", F.col("leaf").alias("digest"), "doc_id", "changed"))
    leaf_nodes = checkpointed(leaf_nodes, "manifest-places")
    leaf = F.struct("digest", "doc_id", "changed")
    levels, subroots = _levels(leaf_nodes, leaf, "manifest-level")
    subroots = checkpointed(subroots, "manifest-subroots")
    source_nodes = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"),
                                   F.lit(n_sources).cast("long").alias("n"), "digest")
    source_levels, roots = _levels(source_nodes, F.struct("digest"), "manifest-source-level")
    nothing = F.array().cast(STEP)
    if source_levels:
        above = _descend(source_levels, roots.select("tree", nothing.alias("path")), "manifest-source-path")
        above = above.select(F.col("place").alias("tree"), F.col("child.digest").alias("subroot"), "path")
    else:
        above = subroots.select("tree", F.col("digest").alias("subroot"), nothing.alias("path"))
    above = checkpointed(above, "manifest-source-paths")
    # a null root, never read, if the table is empty
    root = roots.agg(F.max("digest")).first()[0]
    lone = (leaf_nodes.filter("n = 1").join(above, "tree")
            .select("tree", F.struct("digest", "doc_id", "changed").alias("child"), "path"))
    every = lone
    if levels:
        every = lone.unionByName(_descend(levels, above.select("tree", "path"), "manifest-path")
                                 .select("tree", "child", "path"))
    proof = F.sha2(F.encode(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), "UTF-8"), 256)
    out = every.join(above.select("tree", "subroot"), "tree").select(
        "child.doc_id", F.col("child.digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        proof.alias("proof_sha256"),
        _fold(F.coalesce("child.changed", "child.digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
