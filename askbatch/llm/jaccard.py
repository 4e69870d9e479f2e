"""Exact Jaccard join of shingle sets with signature trees.

1. A text is lower-cased (A-Z), cut into words and hashed shingles; equal sets
   are one class, represented by its smallest identifier.
2. Keys that two sets with Jaccard >= t surely share form blocks.
   From a similarity of PARTS_FROM percent the keys are parts: sets are put
   into size classes of ratio t, so that a pair lies in one class or in two
   neighbouring ones; there at most d = (1 - t) / (1 + t) * (sizes) shingles
   differ, and of d + 1 ranges of the hash space at least one holds equal
   shingles. Such a part has about 8 shingles, so chance hardly meets in it.
   Below, where parts would hold few shingles, the keys are the first
   n - ceil(t * n) + 1 shingles in an order that puts frequent ones last:
   their counts come from all documents, and the list of the most frequent
   ones is bounded (it only sets the order; results do not depend on it).
3. Each set of a block is first held against the smallest identifier of the
   block; pairs that pass their bitmaps are verified on the whole texts, and
   verified links are contracted.
4. Blocks that still hold several components become signature trees: the
   documents are the leaves, nodes hold the OR of the shingle bitmaps below
   them and their size range. A dual traversal drops node pairs whose sizes
   cannot reach t, and pairs for which too many bits of one side are missing
   on the other to leave the needed overlap. Blocks of equal members are
   traversed once; large blocks are split into pieces, and pairs of pieces
   whose sizes and components leave something to find are traversed apart.
   Surviving pairs are verified on the whole texts.

Only components are asked for, so no step lists all pairs of a group.

Edge cases: null, empty or blank text has an empty set and links with nothing;
fewer words than a shingle form one shingle; null identifiers link with
nothing and have a null component; rows that share an identifier are one node.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .bpe import bounded
from .common import whole_text, with_group_totals
from .components import connected_components

BITS = 1024             # bitmap of a set where parts are keys
WIDE_BITS = 4096        # and where prefixes are: their blocks hold more chance pairs
PARTS_FROM = 88         # percent; parts as keys from here, prefixes below
PIECE = 2048            # rows of a block that one signature tree takes
FREQUENT = 1 << 16      # frequent shingles put last
SEEN_TWICE = 3          # counts below this in a batch of texts are not reported
FANOUT = 8
SMALL = 16              # a tree is built above this block size
BATCH_BYTES = 8 << 20
SALTS = 256
CACHE_WORDS = 250_000
CACHE_TEXTS = 8 << 20   # bytes of texts whose sets a task keeps while verifying
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Shingles:
    """Texts (UTF-8 bytes) to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def hashed(self, words: list[bytes]) -> np.ndarray:
        """The hash of each run of `size` words (of all words if fewer)."""
        import xxhash
        try:
            h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(MIX[0]) + h[i:i + len(out)] * np.uint64(MIX[1])
        out ^= out >> np.uint64(29)
        out *= np.uint64(MIX[2])
        out ^= out >> np.uint64(32)
        return out + np.uint64(k)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()    # of bytes: A-Z only, and the six ASCII spaces
        return np.unique(self.hashed(words)) if words else np.zeros(0, np.uint64)


def needed(n: np.ndarray | int, percent: int):
    """Smallest overlap that a set of n shingles needs: ceil(n * percent / 100)."""
    return -(-(n * percent) // 100)


def prefix(shingles: np.ndarray, frequent: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """First n - needed(n) + 1 shingles; frequent ones come last, rarest
    first. `frequent` is sorted, `order` holds the ranks in the same places."""
    size = len(shingles) - needed(len(shingles), percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, order[at], -1)
        if (rank >= 0).any():
            shingles = shingles[np.lexsort((shingles, rank))]
    return shingles[:size]


class Parts:
    """Keys of sets by size class; see step 2 above."""

    def __init__(self, percent: int):
        self.percent, self.low, self.levels = percent, [1], []

    def _level(self, i: int) -> tuple[int, np.ndarray]:
        """Largest size that level i serves, and its part bounds."""
        while len(self.levels) <= i:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
            smaller = self.low[-1] - 1
            larger = smaller * 100 // self.percent
            parts = (smaller + larger) * (100 - self.percent) // (100 + self.percent) + 1
            self.levels.append((larger, np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)))
        return self.levels[i]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        n, c = len(shingles), 0
        if not n:
            return np.zeros(0, np.uint64)
        while True:
            self._level(c)
            if n < self.low[c + 1]:
                break
            c += 1
        x = (shingles ^ (shingles >> np.uint64(30))) * np.uint64(MIX[1])
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(27)), dtype=np.uint64)]
        keys = []
        for level in (c, c - 1):        # as the smaller set of a pair, as the larger one
            if level < 0:
                continue
            largest, bounds = self._level(level)
            if n > largest or not len(bounds):      # one part: only equal sets, which are one class
                continue
            ends = np.r_[0, np.searchsorted(shingles, bounds), n]
            place = np.arange(len(ends) - 1, dtype=np.uint64) + np.uint64(level << 40)
            k = (total[ends[1:]] - total[ends[:-1]]) + (place + np.uint64(1)) * np.uint64(MIX[0])
            k = (k ^ (k >> np.uint64(31))) * np.uint64(MIX[2])
            keys.append(k ^ (k >> np.uint64(29)))
        return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def bitmap(shingles: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(shingles % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(F.col(text_col)).cast("binary").alias("text"))


def frequent_shingles(texts: DataFrame, size: int, limit: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, rarest first. Counts run over all texts;
    at most `limit` hashes reach the driver."""
    def run(batches):
        shingles = Shingles(size)
        held, weight = [], 0

        def report():
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= SEEN_TWICE
            return pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(counts[some])],
                                              names=["h", "c"])
        for b in batches:
            for text in b.column("text"):
                data = text.as_py()
                held.append(shingles(data))
                weight += len(data)
                if weight >= BATCH_BYTES:
                    yield report()
                    held, weight = [], 0
        if held:
            yield report()

    rows = (texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
            .filter("c >= 16").orderBy(F.col("c").desc(), "h").limit(limit).collect())
    return np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)


def _sets(texts: DataFrame, size: int, percent: int, frequent: np.ndarray | None) -> DataFrame:
    """Per row the number of its shingles, the digest of its set, bits and
    block keys; without a frequent list the keys are parts. One pass over the
    texts, which no later join carries unless they are verified."""
    width = BITS if frequent is None else WIDE_BITS
    if frequent is None:
        keys_of = Parts(percent)
    else:
        order = np.argsort(frequent)
        by_value = frequent[order]

        def keys_of(s):
            return prefix(s, by_value, order, percent)

    def run(batches):
        shingles = Shingles(size)
        for b in batches:
            for ids, some in bounded(b.column("id"), b.column("text"), BATCH_BYTES // 4):
                sets = list(map(shingles, some))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([bitmap(s, width).tobytes() for s in sets], pa.binary()),
                     pa.array([keys_of(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["id", "n", "digest", "bits", "keys"])
    return checkpointed(texts.mapInArrow(run, "id long, n long, digest binary, bits binary, keys array<long>"),
                        "shingle-sets")


def _class_table(sets: DataFrame) -> DataFrame:
    """Per row n and rep, the smallest identifier with the same set."""
    rows = sets.select("id", "n", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = rows.filter("n > 0 and id is not null").groupBy("digest", "salt").agg(F.min("id").alias("part"))
    linked = with_group_totals(rows.filter("n > 0 and id is not null"), "digest", "salt", parts,
                               {"rep": F.min("part")}).select("id", "n", "rep")
    alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("rep"))
    return checkpointed(linked.unionByName(alone), "shingle-reps")


class SignatureTree:
    """Documents of a block, sorted by size; level 0 are the leaves."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray):
        self.levels = [(sizes, sizes, bits, bits, groups, groups)]
        while len(self.levels[-1][0]) > 1:
            low, high, either, every, g_min, g_max = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.bitwise_or.reduceat(either, at), np.bitwise_and.reduceat(every, at),
                                np.minimum.reduceat(g_min, at), np.maximum.reduceat(g_max, at)))

    def _possible(self, level: int, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
        low, high, either, every, g_min, g_max = self.levels[level]
        # one group only on both sides: nothing to find
        keep = ~((g_min[p] == g_max[p]) & (g_min[q] == g_max[q]) & (g_min[p] == g_min[q]))
        # sizes: the largest of the smaller side against the smallest of the larger one
        keep &= (high[p] * 100 >= low[q] * percent) & (high[q] * 100 >= low[p] * percent)
        for a, b in ((p, q), (q, p)):
            some = np.flatnonzero(keep)
            # bits that every set of a has and no set of b: shingles surely not shared
            lost = np.bitwise_count(every[a[some]] & ~either[b[some]]).sum(axis=1, dtype=np.int64)
            # overlap <= high[a] - lost, and 100 * overlap >= percent * union >= percent * size
            keep[some] = 100 * (high[a[some]] - lost) >= percent * np.maximum(low[a[some]], low[b[some]])
        if level == 0:
            some = np.flatnonzero(keep)
            apart = np.bitwise_count(either[p[some]] ^ either[q[some]]).sum(axis=1, dtype=np.int64)
            total = low[p[some]] + low[q[some]]
            # symmetric difference d: overlap = (total - d) / 2, union = (total + d) / 2
            keep[some] = 100 * (total - apart) >= percent * (total + apart)
        return keep

    def pairs(self, percent: int):
        """Leaf pairs of different groups that may reach the similarity, in
        bounded pieces."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, p, q = todo.pop()
            if len(p) > 1 << 15:
                todo += [(level, p[1 << 15:], q[1 << 15:]), (level, p[:1 << 15], q[:1 << 15])]
                continue
            if level:
                inside = self._possible(level, p, q, percent) if level < top else np.ones(len(p), bool)
                p, q = p[inside], q[inside]
                n = len(self.levels[level - 1][0])
                i = (p[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
                j = (q[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
                i, j = (x.ravel() for x in np.broadcast_arrays(i, j))
                ok = (i < n) & (j < n) & (i <= j)
                todo.append((level - 1, i[ok], j[ok]))
            else:
                p, q = p[p != q], q[p != q]
                keep = self._possible(0, p, q, percent)
                if keep.any():
                    yield p[keep], q[keep]


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of blocks (h, id, n, bits, grp), rows sorted by h."""
    def small(h, ids, sizes, bits, groups):
        """Blocks of up to SMALL rows, all of them at once: each row with the
        row d places before it in its block."""
        order = np.lexsort((ids, sizes, h))
        h, ids, sizes, bits, groups = h[order], ids[order], sizes[order], bits[order], groups[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        for d in range(1, int(place.max()) + 1):
            q = np.flatnonzero(place >= d)
            p = q - d
            some = (groups[p] != groups[q]) & (sizes[p] * 100 >= sizes[q] * percent)
            p, q = p[some], q[some]
            apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
            total = sizes[p] + sizes[q]
            some = 100 * (total - apart) >= percent * (total + apart)
            a, b = ids[p[some]], ids[q[some]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def emit(ids, sizes, bits, groups):
        order = np.lexsort((ids, sizes))
        tree = SignatureTree(sizes[order], bits[order], groups[order])
        for p, q in tree.pairs(percent):
            a, b = ids[order[p]], ids[order[q]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        held = None         # rows of the block that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("h", "id", "n")]
            rows.append(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            rows.append(batch.column("grp").to_numpy())
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            end = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[end:] for x in rows]
            yield from blocks_of([x[:end] for x in rows])
        if held is not None:
            yield from blocks_of(held)

    def blocks_of(rows):
        if not len(rows[0]):
            return
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        sizes = np.diff(np.r_[first, len(rows[0])])
        little = np.repeat(sizes <= SMALL, sizes)
        if little.any():
            yield from small(*(x[little] for x in rows))
        for s, n in zip(first[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            yield from emit(*(x[s:s + n] for x in rows[1:]))

    return (blocks.select("h", "id", "n", "bits", "grp").repartition(F.col("h")).sortWithinPartitions("h", "id")
            .mapInArrow(run, "a long, b long").distinct())


def _pieces(blocks: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Blocks (h, id, grp, members) of more than PIECE rows as blocks of two
    pieces each (h, id, grp). Rows of one component share pieces."""
    own = blocks.groupBy("h", "grp").agg(F.count(F.lit(1)).alias("own"))
    rows = blocks.join(own, ["h", "grp"]).select(
        "h", "id", "grp",
        (F.pmod(F.xxhash64("grp"), F.ceil(F.col("members") / PIECE)) * F.lit(1 << 31)
         + F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / PIECE))).alias("piece"))
    rows = checkpointed(rows, "block-pieces")
    ends = (rows.join(sizes, "id").groupBy("h", "piece")
            .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("grp").alias("lo"), F.max("grp").alias("hi")))
    p, q = (ends.select("h", *[F.col(c).alias(f"{side}_{c}") for c in ends.columns[1:]]) for side in "pq")
    met = (p.join(q, "h").filter("p_piece <= q_piece and not (p_lo = p_hi and q_lo = q_hi and p_lo = q_lo)")
           .filter((F.col("p_high") * 100 >= F.col("q_low") * percent) & (F.col("q_high") * 100 >= F.col("p_low") * percent))
           .select("h", F.xxhash64("h", "p_piece", "q_piece").alias("met"),
                   F.explode(F.array_distinct(F.array("p_piece", "q_piece"))).alias("piece")))
    return rows.join(met, ["h", "piece"]).select(F.col("met").alias("h"), "id", "grp")


def _possible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave the similarity possible."""
    def check(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes = [b.column(c).to_numpy() for c in ("na", "nb")]
            bits = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("ba", "bb")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            total = sizes[0] + sizes[1]
            ok = pa.array(100 * (total - apart) >= percent * (total + apart))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(ok)

    for end in "ab":
        pairs = pairs.join(signed.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"),
                                         F.col("bits").alias(f"b{end}")), end)
    return (pairs.filter((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
            .select("a", "b", "na", "nb", "ba", "bb").mapInArrow(check, "a long, b long").distinct())


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity. Texts travel, not their
    sets: they compress."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def check(batches):
        shingles = Shingles(size)
        known, weight = {}, 0
        for b in batches:
            ok = []
            for pair in zip(b.column("ta"), b.column("tb"), strict=True):
                sets = []
                for text in (t.as_py() for t in pair):
                    if text not in known:
                        if weight > CACHE_TEXTS:
                            known, weight = {}, 0
                        known[text] = shingles(text)
                        weight += len(text)
                    sets.append(known[text])
                x, y = sets
                if not len(x) or not len(y):
                    ok.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = checkpointed(texts.join(ends, "id", "left_semi"), "candidate-texts")
    return (pairs.join(found.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(found.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct())


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    texts = _texts(docs, id_col, text_col)
    frequent = None if percent >= PARTS_FROM else frequent_shingles(texts, shingle)
    sets = _sets(texts, shingle, percent, frequent)
    classes = _class_table(sets)
    # identifiers that represent no class leave; they are fewer than those that do
    copies = checkpointed(classes.filter("n > 0").groupBy("id").agg(F.max(F.col("id") == F.col("rep")).alias("own"))
                          .filter("not own").select("id"), "copies")
    signed = checkpointed(sets.filter("n > 0 and id is not null").select("id", "n", "bits", "keys")
                          .join(copies, "id", "left_anti"), "shingle-signatures")

    # keys in two documents; the counts are pre-aggregated, and a hot key's
    # rows meet one row each in a join that Spark splits
    keys = signed.select("id", F.explode("keys").alias("h"))
    heads = checkpointed(keys.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                         .filter("first <> last").select("h", "first"), "block-heads")
    members = checkpointed(keys.join(heads, "h"), "blocks")
    signed = signed.select("id", "n", "bits")

    near = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    first = checkpointed(_possible(near, signed, percent), "jaccard-candidates")
    links = checkpointed(_verified(first, texts, shingle, percent), "jaccard-links")
    merged = checkpointed(connected_components(links, "a", "b"), "jaccard-merged")

    grouped = (members.select("h", "id").join(merged.withColumnRenamed("node", "id"), "id", "left")
               .select("h", "id", F.coalesce("component", "id").alias("grp")))
    # nothing is left to find in blocks of one component or of two rows;
    # blocks of the same members are one
    mixed = checkpointed(
        grouped.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min("grp").alias("lo"), F.max("grp").alias("hi"),
                                 F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        .filter("members > 2 and lo <> hi").groupBy("members", "x", "y").agg(F.min("h").alias("h"))
        .select("h", "members"), "mixed-blocks")
    blocks = checkpointed(grouped.join(mixed, "h"), "mixed-rows")
    trees = (blocks.filter(F.col("members") <= PIECE).select("h", "id", "grp")
             .unionByName(_pieces(blocks.filter(F.col("members") > PIECE), signed.select("id", "n"), percent)))
    rest = _block_pairs(trees.join(signed, "id"), percent).join(first, ["a", "b"], "left_anti")
    more = _verified(checkpointed(rest, "jaccard-candidates"), texts, shingle, percent)
    final = checkpointed(connected_components(links.unionByName(more), "a", "b"), "jaccard-components")
    return (classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "rep").alias("component_id")))
