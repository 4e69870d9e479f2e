"""Approximate nearest neighbours by inner product: a vantage-point tree per
shard, triangle-inequality pruning relaxed by a tunable factor.

Largest inner product becomes nearest distance by one more component: with M
the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x is a metric distance that falls as the
product grows. Shard centres are fitted on a bounded sample (SAMPLE distinct
vectors); every vector is placed with its nearest centre, and a shard of more
than SHARD vectors is dealt over several trees. A query first searches the
shard nearest to it, which gives the distance of its k-th neighbour so far, and
then every shard whose bound (distance to the centre less the radius), times
`factor`, is not beyond it. Within a tree the bound of a branch is the gap
between the query's distance to the vantage point and the branch's range of
distances, pruned in the same way. With factor 1 nothing is lost: the search is
exact. Larger factors prune more.

Equal vectors are one point of a tree with their k + 1 smallest identifiers,
which are all that k answers can need. Candidates are scored by the plain sum
of products in double precision on the original vectors.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows without an identifier take no part; a query's own row is
every row with its identifier; equal rows count once; different vectors under
one identifier are separate candidates and separate queries; vectors of
different lengths never meet; ties go to the smaller identifier; an empty
table, or none but the query, gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

SAMPLE = 4096          # vectors that shard centres are fitted on
SHARD = 8192           # vectors of a tree, about
QUERIES = 8192         # queries of a task, about
LEAF = 128
SPARE = 8              # candidates kept beyond k before the exact scores
ODD = 16               # shards of vector lengths that the sample lacks
DEFAULT_FACTOR = 2.0   # recall measured in the README; 1 is exact


def _by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) per vector length of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out.append((at, flat[offsets[at][:, None] + np.arange(n)]))
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """The vectors with their extra component."""
    return np.c_[x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to each row of b, by the product form."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def fit_centres(x: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n centres of the sample: Lloyd rounds from its first n rows."""
    centres = x[:n].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


class Shards:
    """Centres by vector length, numbered through; radius and number of trees
    of each shard, once the vectors are placed. Bounded by SAMPLE and ODD."""

    def __init__(self, sample: list, wanted: int, top: float):
        self.top, self.first, self.centres, n = top, {}, {}, 0
        lengths = [len(v) for v in sample]
        for d in sorted(set(lengths)):
            x = np.array([v for v in sample if len(v) == d], np.float64)
            own = max(1, min(len(x), round(wanted * len(x) / len(sample))))
            self.first[d], self.centres[d] = n, fit_centres(_lift(x, top), own)
            n += own
        self.radius = np.zeros(n)
        self.trees: dict[int, int] = {}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, distance to its centre) of vectors of one length."""
        d = x.shape[1]
        if d not in self.first:
            return np.full(len(x), -1 - d % ODD), np.zeros(len(x))
        gap = _distances(_lift(x, self.top), self.centres[d])
        near = gap.argmin(axis=1)
        return self.first[d] + near, gap[np.arange(len(x)), near]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shards, lower bound of the distance) for queries of one length."""
        d = q.shape[1]
        if d not in self.first:
            return np.array([-1 - d % ODD]), np.zeros((len(q), 1))
        gap = _distances(np.c_[q, np.zeros(len(q))], self.centres[d])
        own = self.first[d] + np.arange(gap.shape[1])
        return own, np.maximum(0.0, gap - self.radius[own])


class VantageTree:
    """Vectors of one length. A node is (vantage, branches), a branch being
    (nearest, farthest distance to the vantage point, node), or a leaf's rows."""

    def __init__(self, x: np.ndarray, top: float):
        self.x, self.top = x, top
        self.lifted = _lift(x, top)
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        # the row farthest from the first one: its distances spread most
        start = _distances(self.lifted[rows], self.lifted[rows[:1]])[:, 0]
        vantage = rows[start.argmax()]
        gap = _distances(self.lifted[rows], self.lifted[[vantage]])[:, 0]
        near = gap <= np.median(gap)
        if near.all():
            return rows
        return vantage, [(gap[side].min(), gap[side].max(), self._grow(rows[side])) for side in (near, ~near)]

    def search(self, q: np.ndarray, k: int, floor: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the best k + SPARE points a query, -1 where there
        are fewer. `floor`: a score that k candidates elsewhere reach already."""
        width = k + SPARE
        self.score = np.full((len(q), width), -np.inf)
        self.at = np.full((len(q), width), -1)
        self.q, self.k, self.floor, self.factor = q, k, floor, factor
        self.reach = (q * q).sum(axis=1) + self.top
        self.slack = 1e-7 * np.sqrt(self.reach)
        self._visit(self.root, np.arange(len(q)))
        return self.score, self.at

    def _wanted(self, who: np.ndarray, bound: np.ndarray) -> np.ndarray:
        known = np.maximum(self.score[who, self.k - 1], self.floor[who])
        radius = np.sqrt(np.maximum(0.0, self.reach[who] - 2.0 * known))
        return bound * self.factor <= radius + self.slack[who]

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            score = np.hstack([self.score[who], self.q[who] @ self.x[node].T])
            at = np.hstack([self.at[who], np.broadcast_to(node, (len(who), len(node)))])
            best = np.argsort(-score, axis=1, kind="stable")[:, :self.score.shape[1]]
            self.score[who] = np.take_along_axis(score, best, axis=1)
            self.at[who] = np.take_along_axis(at, best, axis=1)
            return
        vantage, branches = node
        gap = np.sqrt(np.maximum(0.0, self.reach[who] - 2.0 * (self.q[who] @ self.x[vantage])))
        bound = [np.maximum(0.0, np.maximum(low - gap, gap - high)) for low, high, _ in branches]
        inner = gap <= (branches[0][1] + branches[1][0]) / 2
        for first in (0, 1):            # the nearer branch of each query first
            mine = inner if first == 0 else ~inner
            for b in (first, 1 - first):
                go = who[mine]
                self._visit(branches[b][2], go[self._wanted(go, bound[b][mine])])


def _usable(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """id, v (array of doubles), is_query of the rows that take part."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                           is_query.alias("is_query"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
            .filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)))


def _routed(queries: DataFrame, shards: Shards, chunks: int, factor: float, home: bool) -> DataFrame:
    """One row per query and tree to search: the shard with the least bound
    (`home`), or all others within reach of the k-th score so far (`floor`)."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            floor = b.column("floor").to_numpy()
            chunk = np.abs(b.column("qh").to_numpy()) % chunks
            rows, shard, tree = [], [], []
            for at, q in _by_length(b.column("qv")):
                own, bound = shards.bounds(q)
                nearest = bound.argmin(axis=1)
                if home:
                    go = np.zeros(bound.shape, bool)
                    go[np.arange(len(at)), nearest] = True
                else:
                    reach = (q * q).sum(axis=1) + shards.top
                    radius = np.sqrt(np.maximum(0.0, reach - 2.0 * floor[at]))
                    go = bound * factor <= (radius + 1e-7 * np.sqrt(reach))[:, None]
                    go[np.arange(len(at)), nearest] = False
                for i, j in zip(*np.nonzero(go), strict=True):
                    s = int(own[j])
                    for t in range(shards.trees.get(s, 0)):
                        rows.append(at[i])
                        shard.append(s)
                        tree.append(t)
            if rows:
                rows = np.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(tree, pa.int32()), pa.array(chunk[rows].astype(np.int32)),
                     *[b.column(c).take(pa.array(rows)) for c in ("qid", "qh", "qv", "floor")]],
                    names=["shard", "tree", "chunk", "qid", "qh", "qv", "floor"])

    return queries.select("qid", "qh", "qv", "floor").mapInArrow(
        run, "shard int, tree int, chunk int, qid long, qh long, qv array<double>, floor double")


def _answers(placed: DataFrame, routed: DataFrame, k: int, factor: float, top: float) -> DataFrame:
    """qid, qh, vec_id, score: of each query and tree the best k identifiers."""
    asked = routed.select("shard", "tree", F.col("chunk").alias("part")).distinct()
    points = placed.join(asked, ["shard", "tree"]).select("shard", "tree", "part", "v", "ids")
    empty = pa.table({"qid": pa.array([], pa.int64()), "qh": pa.array([], pa.int64()),
                      "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(mine: pa.Table, asking: pa.Table) -> pa.Table:
        if not mine.num_rows or not asking.num_rows:
            return empty
        ids = mine.column("ids").to_pylist()
        matrices = {x.shape[1]: (at, x) for at, x in _by_length(mine.column("v"))}
        qid, qh = asking.column("qid").to_numpy(), asking.column("qh").to_numpy()
        floor = asking.column("floor").to_numpy()
        out = ([], [], [], [])
        for at, q in _by_length(asking.column("qv")):
            if q.shape[1] not in matrices:
                continue
            where, x = matrices[q.shape[1]]
            # a query's own point may hold no other row, so one more is wanted
            _, found = VantageTree(x, top).search(q, k + 1, floor[at], factor)
            for i, near in enumerate(found):
                near = near[near >= 0]
                exact = np.cumsum(x[near] * q[i], axis=1)[:, -1]    # one product after the other
                me = qid[at[i]]
                best = sorted((-s, o) for s, n in zip(exact, near, strict=True) if s >= floor[at[i]]
                              for o in ids[where[n]] if o != me)[:k]
                out[0].extend([me] * len(best))
                out[1].extend([qh[at[i]]] * len(best))
                out[2].extend(o for _, o in best)
                out[3].extend(-s for s, _ in best)
        return pa.table({"qid": pa.array(out[0], pa.int64()), "qh": pa.array(out[1], pa.int64()),
                         "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    return (points.groupBy("shard", "tree", "part").cogroup(routed.groupBy("shard", "tree", "chunk"))
            .applyInArrow(run, "qid long, qh long, vec_id long, score double"))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = DEFAULT_FACTOR,
                       id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `is_query`
    marks its k nearest other rows."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vec_col, is_query)
    # points: distinct vectors with their k + 1 smallest identifiers; the rank
    # is cut in every map task before its shuffle, so copies do not gather
    order = Window.partitionBy("v").orderBy("id")
    points = checkpointed(
        rows.dropDuplicates(["id", "v"]).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "ann-points")
    queries = checkpointed(
        rows.filter("is_query").select(F.col("id").alias("qid"), F.xxhash64("v").alias("qh"), F.col("v").alias("qv"))
        .dropDuplicates(["qid", "qv"]), "ann-queries")
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top")).first()
    asked = queries.count()
    if not size["n"] or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = float(size["top"])
    sample = [r["v"] for r in points.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    shards = Shards(sample, -(-size["n"] // shard), top)

    def place(batches):
        for b in batches:
            number, gap = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, x in _by_length(b.column("v")):
                number[at], gap[at] = shards.place(x)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(gap), b.column("v"), b.column("ids")],
                                             names=["shard", "gap", "v", "ids"])

    placed = checkpointed(points.select("v", "ids").mapInArrow(
        place, "shard int, gap double, v array<double>, ids array<long>"), "ann-placed")
    # one row per shard, at most SAMPLE + ODD
    for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect():
        shards.trees[r["shard"]] = -(-r["n"] // shard)
        if r["shard"] >= 0:
            shards.radius[r["shard"]] = r["radius"] * (1 + 1e-9)
    trees = spark.createDataFrame(sorted(shards.trees.items()), "shard int, trees int")
    placed = (placed.join(F.broadcast(trees), "shard")
              .withColumn("tree", F.pmod(F.xxhash64("v"), F.col("trees")).cast("int"))
              .select("shard", "tree", "v", "ids"))

    chunks = -(-asked // QUERIES)
    start = queries.withColumn("floor", F.lit(float("-inf")))
    home = checkpointed(_answers(placed, _routed(start, shards, chunks, factor, home=True), k, factor, top), "ann-home")
    floor = home.groupBy("qid", "qh").agg(F.count(F.lit(1)).alias("n"), F.sort_array(
        F.collect_list("score"), asc=False).alias("scores")).select(
        "qid", "qh", F.when(F.col("n") >= k, F.get("scores", F.lit(k - 1))).alias("floor"))
    again = queries.join(floor, ["qid", "qh"], "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("-inf"))))
    # read twice: once for the keys of the trees, once for the queries
    routed = checkpointed(_routed(again, shards, chunks, factor, home=False), "ann-routed")
    others = _answers(placed, routed, k, factor, top)
    best = Window.partitionBy("qid", "qh").orderBy(F.col("score").desc(), "vec_id")
    return (home.unionByName(others).dropDuplicates(["qid", "qh", "vec_id", "score"])
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
