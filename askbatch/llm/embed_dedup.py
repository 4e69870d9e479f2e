"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables,
reranking with the original vectors.

A rotation that balances binary codes is learned on a bounded sample (SAMPLE
vectors); every vector is coded and indexed. The code is cut into parts, one
Hamming table each, whose width grows with the number of vectors. A vector lies
in the bucket of its own part (as a resident) and visits the buckets whose bits
a linked vector may have. Which ones follows from the geometry: a bit differs
only if the two projections x and y have different signs, so |x| + |y| is at
most the difference there, and the squared differences of all bits sum to at
most 2 - 2 cosine. By pigeonhole the flipped bits of some part cost one of the
two vectors (the sum of its squared projections) no more than
(1 - cosine) / parts. Visiting all buckets within that cost finds every link,
whatever the distribution; how many they are depends on it.

A vector that would visit as many buckets as a table has (its projections are
tiny, as when all vectors share a strong common direction) is wide: tables tell
nothing about it, so it is compared with every vector of its label, which is
also what its links ask for.

Blocks are counted on narrow rows first and cut into chunks of visitors and of
residents, every pair of chunks a task; the vectors join last. Cosines are
computed in double precision; a pair counts in the first table in which it
meets, seen from one side, so nothing is listed or counted twice and no pair
leaves a task: a task returns per vector its number of links and the smallest
identifier of its local component. Equal vectors of a label are one class with
a multiplicity.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows with a null label or identifier link with nothing; vectors
of different lengths never meet; rows that share an identifier are separate
vectors, each with its own links, and one node. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import with_group_totals
from .components import connected_components

SAMPLE = 4096
TABLES = 2          # more of them cost more copies of each vector than they spare
CHUNK = 1024        # visitors or residents of a task
BUCKET = 256        # vectors of a label and bucket from which parts become wider
WIDTHS = (4, 20)    # least and most bits of a part
SALTS = 256
ROUNDS = 30
NO_TABLE = -1       # the block of a whole label, for wide vectors


def learn_rotation(x: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes, rotated so that signs lose least."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    pca = axes[:min(bits, len(axes))].T
    v = centred @ pca
    rng = np.random.default_rng(seed)
    r, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
    for _ in range(ROUNDS):
        codes = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(codes.T @ v)
        r = (u @ w).T
    return mean, pca @ r


def _vectors(batch) -> tuple[np.ndarray, list]:
    vectors, ok = [], []
    for x in batch:
        v = x.as_py()
        good = v is not None and len(v) > 0 and all(e is not None for e in v)
        if good:
            a = np.array(v, np.float64)
            n = np.linalg.norm(a) if np.isfinite(a).all() else 0.0
            good = bool(np.isfinite(n) and n > 0)
        ok.append(good)
        vectors.append(a if good else None)
    return np.array(ok, bool), vectors


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, str]:
    """id, label, vector (the bytes of its components) and the digest of both,
    and the kind of the components; the vector is null where a row links with
    nothing."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vec_col).alias("v"))
    kind = "<f4" if src.schema["v"].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches):
        for b in batches:
            ok, vs = _vectors(b.column("v"))
            ok &= np.array([x.is_valid and y.is_valid for x, y in zip(b.column("id"), b.column("label"), strict=True)], bool)
            data = [v.astype(kind).tobytes() if k else None for k, v in zip(ok, vs, strict=True)]
            digest = [hashlib.blake2b(f"{y.as_py()}\0".encode() + v, digest_size=16).digest() if v is not None else None
                      for v, y in zip(data, b.column("label"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(data, pa.binary()),
                                              pa.array(digest, pa.binary())], names=["id", "label", "v", "digest"])

    return src.mapInArrow(run, "id long, label string, v binary, digest binary"), kind


class Codes:
    """Codes of vectors and the buckets they visit."""

    def __init__(self, sample: np.ndarray, width: int, cosine: float, tables: int = TABLES, kind: str = "<f8"):
        size = sample.shape[1]
        self.kind, self.bytes = kind, size * np.dtype(kind).itemsize
        self.width = min(width, size)
        self.tables = max(1, min(tables, size // self.width))
        self.mean, self.projection = learn_rotation(sample, self.tables * self.width)
        self.width = self.projection.shape[1] // self.tables    # fewer sample vectors than bits
        self.projection = self.projection[:, :self.tables * self.width]
        self.budget = max(0.0, 1.0 - cosine) / self.tables * (1 + 1e-9) + 1e-12

    def project(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, width)"""
        return ((x - self.mean) @ self.projection).reshape(len(x), self.tables, self.width)

    def parts(self, z: np.ndarray) -> np.ndarray:
        return ((z >= 0).astype(np.int64) << np.arange(self.width)).sum(axis=2)

    def visits(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, table, bucket) of all visits, own buckets included, and
        which vectors are wide; those have no visits."""
        n, own, cost = len(z), self.parts(z), z ** 2
        wide = np.zeros(n, bool)
        owner, table = (a.ravel() for a in np.indices((n, self.tables)))
        flips, spent = np.zeros(len(owner), np.int64), np.zeros(len(owner))
        for bit in range(self.width):
            more = spent + cost[owner, table, bit]
            fits = more <= self.budget
            owner, table = np.r_[owner, owner[fits]], np.r_[table, table[fits]]
            flips, spent = np.r_[flips, flips[fits] | 1 << bit], np.r_[spent, more[fits]]
            wide |= np.bincount(owner, minlength=n) >= max(2 << self.width - 1, self.tables + 1)
            narrow = ~wide[owner]
            owner, table, flips, spent = owner[narrow], table[narrow], flips[narrow], spent[narrow]
        return owner, table, own[owner, table] ^ flips, wide

    def cost(self, z: np.ndarray, flipped: np.ndarray) -> np.ndarray:
        """(pairs, tables): what the flipped bits cost the vectors."""
        return (z ** 2 * flipped).sum(axis=2)


def _places(reps: DataFrame, codes: Codes) -> DataFrame:
    """One narrow row per vector and block: block, whether the vector visits it
    and whether it is a resident, digest."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                raw, digest, label = (some.column(k).to_pylist() for k in range(3))
                fits = np.array([len(x) == codes.bytes for x in raw])
                place, wide = [], ~fits
                if fits.any():
                    index = np.flatnonzero(fits)
                    z = codes.project(unit_rows([raw[i] for i in index], codes.kind))
                    owner, table, bucket, w = codes.visits(z)
                    wide[index] = w
                    place += [(int(i), f"{t}|{k}", True, bool(h)) for i, t, k, h in zip(
                        index[owner], table, bucket, bucket == codes.parts(z)[owner, table], strict=True)]
                # all are residents of their label; blocks without a visitor go
                place += [(i, f"{NO_TABLE}|{len(raw[i])}", bool(wide[i]), True) for i in range(len(raw))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{k}|{label[i]}" for i, k, _, _ in place], pa.string()),
                     pa.array([v for _, _, v, _ in place], pa.bool_()), pa.array([r for _, _, _, r in place], pa.bool_()),
                     pa.array([digest[i] for i, _, _, _ in place], pa.binary())],
                    names=["block", "visitor", "resident", "digest"])

    return reps.select("v", "digest", "label").mapInArrow(run, "block string, visitor boolean, resident boolean, digest binary")


def _tasks(places: DataFrame) -> DataFrame:
    """Places of blocks in which a visitor meets another vector, with their
    task: a chunk of visitors with a chunk of residents."""
    salted = places.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    sizes = (salted.groupBy("block", "salt")
             .agg(F.count_if("visitor").alias("v"), F.count_if("resident").alias("r"), F.count(F.lit(1)).alias("n")))
    sized = with_group_totals(salted, "block", "salt", sizes, {"nv": F.sum("v"), "nr": F.sum("r"), "n": F.sum("n")})
    met = (sized.filter("nv > 0 and nr > 0 and n > 1")
           .withColumns({"kv": F.ceil(F.col("nv") / CHUNK).cast("int"), "kr": F.ceil(F.col("nr") / CHUNK).cast("int")})
           .withColumns({k: F.pmod(F.xxhash64(F.lit("chunk"), "digest"), F.col(n)).cast("int")
                         for k, n in (("ov", "kv"), ("or", "kr"))}))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("kr") - 1), lambda k: F.struct(F.col("ov").alias("cv"), k.alias("cr")))
    as_resident = F.transform(F.sequence(F.lit(0), F.col("kv") - 1), lambda k: F.struct(k.alias("cv"), F.col("or").alias("cr")))
    both = F.array_union(as_visitor, as_resident)
    return (met.withColumn("task", F.explode(F.when(~F.col("resident"), as_visitor).when(~F.col("visitor"), as_resident).otherwise(both)))
            .select("block", "task", (F.col("visitor") & (F.col("task.cv") == F.col("ov"))).alias("visitor"),
                    (F.col("resident") & (F.col("task.cr") == F.col("or"))).alias("resident"),
                    F.col("visitor").alias("wide"), "digest"))


def _least(i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Smallest value reachable over the links i-j."""
    while True:
        now = least.copy()
        np.minimum.at(now, i, least[j])
        np.minimum.at(now, j, now[i])
        if (now == least).all():
            return now
        least = now


def _compare(tasks: DataFrame, reps: DataFrame, codes: Codes, cosine: float) -> DataFrame:
    """Per task and vector: links (weighted, pairs that count here) and the
    smallest identifier of its component within the task."""
    def run(table: pa.Table) -> pa.Table:
        tab = int(table.column("block")[0].as_py().split("|", 1)[0])
        visitor, resident, wide, ids, w = (table.column(c).to_numpy() for c in ("visitor", "resident", "wide", "id", "w"))
        digests = table.column("digest").to_pylist()
        distinct = sorted(set(digests))
        rank = {d: k for k, d in enumerate(distinct)}
        node = np.array([rank[d] for d in digests])
        v = unit_rows(table.column("v").to_pylist(), codes.kind)
        z = codes.project(v) if tab != NO_TABLE else None
        first = np.full(len(distinct), -1)
        first[node] = np.arange(len(node))
        links, left, right = np.zeros(len(distinct), np.int64), [], []
        rows, others = np.flatnonzero(visitor), np.flatnonzero(resident)
        for at in range(0, len(rows), 128):
            some = rows[at:at + 128]
            i, j = np.nonzero(v[some] @ v[others].T >= cosine)
            i, j = some[i], others[j]
            if tab == NO_TABLE:     # of two wide vectors the smaller one visits
                here = (node[i] != node[j]) & (~wide[j] | (node[i] < node[j]))
            else:
                i, j = i[node[i] != node[j]], j[node[i] != node[j]]
                here = _counts_here(codes, z, i, j, node, tab)
            i, j = i[here], j[here]
            np.add.at(links, node[i], w[j])
            np.add.at(links, node[j], w[i])
            left.append(node[i])
            right.append(node[j])
        least = _least(np.concatenate(left or [node[:0]]), np.concatenate(right or [node[:0]]), ids[first])
        hit = np.flatnonzero(links)
        return pa.table({"digest": pa.array([digests[first[k]] for k in hit], pa.binary()),
                         "id": pa.array(ids[first[hit]], pa.int64()), "links": pa.array(links[hit], pa.int64()),
                         "least": pa.array(least[hit], pa.int64())})

    return (tasks.join(reps.select("digest", "id", "w", "v"), "digest").groupBy("block", "task")
            .applyInArrow(run, "digest binary, id long, links long, least long"))


def _counts_here(codes: Codes, z: np.ndarray, i: np.ndarray, j: np.ndarray, node: np.ndarray, tab: int) -> np.ndarray:
    """Of pairs (visitor i, resident j) met in table `tab`: whether this is
    the first table in which one visits the other, and the smaller one where
    both do."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        a, b = i[at:at + 8192], j[at:at + 8192]
        flipped = (z[a] >= 0) != (z[b] >= 0)
        to = codes.cost(z[a], flipped) <= codes.budget
        back = codes.cost(z[b], flipped) <= codes.budget
        new = ~(to[:, :tab] | back[:, :tab]).any(axis=1)
        out[at:at + 8192] = new & to[:, tab] & (~back[:, tab] | (node[a] < node[b]))
    return out


def _width(rows: int, labels: int) -> int:
    """Bits of a part: buckets of about BUCKET vectors of a label."""
    return int(np.clip(np.ceil(np.log2(max(1.0, rows / max(1, labels) / BUCKET))), *WIDTHS))


def embedding_classes(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id",
                      vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    usable, kind = _usable(vectors, id_col, vec_col, label_col)
    rows = checkpointed(usable, "vectors")
    usable = rows.filter("v is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    parts = usable.groupBy("digest", "salt").agg(F.min("id").alias("part_id"), F.count(F.lit(1)).alias("part_n"))
    member = checkpointed(
        with_group_totals(usable.select("id", "label", "v", "digest", "salt"), "digest", "salt", parts,
                          {"rep": F.min("part_id"), "w": F.sum("part_n")}), "vector-classes")
    reps = member.filter("id = rep").dropDuplicates(["digest"])
    # a bounded sample of distinct vectors, the same on every run
    sample = [bytes(r["v"]) for r in reps.select("v", "id", "digest").orderBy(F.xxhash64("id"), "id", "digest").limit(SAMPLE).collect()]
    alone = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).filter("false")
    if sample:
        size = max({len(x) for x in sample}, key=[len(x) for x in sample].count)
        x = unit_rows([v for v in sample if len(v) == size], kind)
        counted = reps.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
        codes = Codes(x, _width(counted["n"], counted["labels"]), cosine, kind=kind)
        tasks = _tasks(checkpointed(_places(reps, codes), "vector-places"))
        found = checkpointed(_compare(tasks, reps, codes, cosine), "vector-links")
        links = found.groupBy("digest").agg(F.sum("links").alias("_links"))
        # members of a class that share no identifier are linked through its smallest
        joint = member.select("id", F.col("rep").alias("least")).filter("id <> least").unionByName(found.select("id", "least"))
        merged = checkpointed(connected_components(joint, "id", "least"), "vector-components")
        alone = (member.select("id", "digest", "w").join(links, "digest", "left")
                 .join(merged.withColumnRenamed("node", "id"), "id", "left")
                 .select("id", (F.col("w") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "id").alias("component_id")))
    lonely = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("id").alias("component_id"))
    return alone.unionByName(lonely).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
