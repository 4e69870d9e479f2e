"""Quality classifier: a factorisation machine over hashed words, word shapes
and structure statistics.

    score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

The pairwise part uses the sum-of-squares identity, so a document costs time
linear in its features. Features: hashed words and hashed word shapes with the
square root of their share, and one indicator per statistic for the bin it
falls in (length, word length, shares of capitals, digits, marks, repeated
neighbours, distinct words, distinct lines). Of the metadata of a document only its length
in characters says something of quality; it is read from the text itself (the
statistic `length`), so a missing or wrong `n_chars` changes no score. The model is trained with AdaGrad
on a bounded sample: at most `per_class` labelled documents of each class,
weighted to the class sizes of the whole table. Their features are computed on
the executors; a document has at most DIMS of them.

Edge cases: null or empty text is scored from its statistics alone; labels
other than 0 and 1 and null identifiers teach nothing; without both classes
every document gets the share of class 1 (0.5 if there is no label at all).
Repeated rows are scored each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bounded
from .common import whole_text
from .learning import fold, stratified_sample

WORD_DIMS, SHAPE_DIMS, BINS = 1 << 14, 1 << 9, 16
STATS = ("length", "word_length", "capitals", "digits", "marks", "repeats", "distinct", "lines")
DIMS = WORD_DIMS + SHAPE_DIMS + BINS * len(STATS)
RANK = 8
PER_CLASS = 3000
CACHE_WORDS = 400_000

_RUNS = re.compile(r"(.)\1+")


def word_shape(word: str) -> str:
    """Capitals A, other letters a, digits 0; runs collapse to one."""
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", s)


class Features:
    """Texts to sparse features; what a distinct word contributes is kept in
    a bounded table per worker."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 6), np.int32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids.clear()
            new = list(words)
        at = len(self.ids)
        while at + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        for w in new:
            raw = w.encode()
            capitals = sum(map(str.isupper, w))
            digits = sum(map(str.isdigit, w))
            letters = sum(map(str.isalpha, w))
            self.table[at] = (zlib.crc32(raw) % WORD_DIMS,
                              WORD_DIMS + zlib.crc32(word_shape(w).encode()) % SHAPE_DIMS,
                              len(w), capitals, digits, len(w) - letters - digits)
            self.ids[w] = at
            at += 1

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        split = [t.split() for t in texts]
        words: set[str] = set()
        for s in split:
            words.update(s)
        self._learn(words)
        return [self._one(t, s) for t, s in zip(texts, split, strict=True)]

    def _one(self, text: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        idx, val = [], []
        stats = np.zeros(len(STATS))
        stats[0] = np.log2(len(text) + 1) / 20
        if n:
            own = np.fromiter(map(self.ids.__getitem__, words), np.int64, n)
            distinct, counts = np.unique(own, return_counts=True)
            rows = self.table[distinct]
            for col in (0, 1):
                share = np.bincount(rows[:, col] - (WORD_DIMS if col else 0), weights=counts)
                hit = np.flatnonzero(share)
                idx.append(hit + (WORD_DIMS if col else 0))
                val.append(np.sqrt(share[hit] / n))
            chars, capitals, digits, marks = (rows[:, 2:] * counts[:, None]).sum(axis=0)
            lines = text.split("\n")
            stats[1:] = (chars / n / 16, capitals / chars, digits / chars, marks / chars,
                         (own[1:] == own[:-1]).mean() if n > 1 else 0, len(distinct) / n,
                         len(set(lines)) / len(lines))
        # shares near zero matter most: the square root spreads them over the bins
        bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(int), BINS - 1)
        idx.append(WORD_DIMS + SHAPE_DIMS + np.arange(len(STATS)) * BINS + bins)
        val.append(np.full(len(STATS), 0.5))
        return np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)


class FactorisationMachine:
    def __init__(self, dims: int = DIMS, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b = np.float32(0)
        self.w = np.zeros(dims, np.float32)
        self.v = rng.normal(0, 0.05, (dims, rank)).astype(np.float32)

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray):
        """Scores of documents whose features stand one after the other (each
        has at least one); also the sums that the gradient needs."""
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[idx] * val, starts)
        return self.b + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray,
            epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 7):
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        prior = float(np.average(y, weights=weight))
        self.b = np.float32(np.log(prior / (1 - prior)))
        weight = weight / weight.mean()
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                idx = np.concatenate([rows[i][0] for i in some])
                val = np.concatenate([rows[i][1] for i in some])
                sizes = np.array([len(rows[i][0]) for i in some])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                raw, sums = self.raw(idx, val, starts)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) * weight[some] / len(some)
                gx = np.repeat(g, sizes) * val
                seen, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, gx, len(seen)) + decay * self.w[seen]
                inner = gx[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[idx] * val[:, None])
                dv = np.stack([np.bincount(back, inner[:, f], len(seen)) for f in range(inner.shape[1])], axis=1)
                dv += decay * self.v[seen]
                gw[seen] += dw * dw
                gv[seen] += dv * dv
                gb += float(g.sum()) ** 2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                self.v[seen] -= rate * dv / np.sqrt(gv[seen])
                self.b -= np.float32(rate * g.sum() / np.sqrt(gb))
        return self


def _featurised(docs: DataFrame) -> DataFrame:
    def run(batches):
        features = Features()
        for b in batches:
            for ids, texts in bounded(b.column("_row"), b.column("_text")):
                rows = features(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([i.tobytes() for i, _ in rows], pa.binary()),
                     pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["_row", "idx", "val"])
    return docs.select("_row", "_text").mapInArrow(run, "_row string, idx binary, val binary")


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", folds: int = 3, held_out: int = 1,
                  per_class: int = PER_CLASS) -> FactorisationMachine | float:
    """A model learned from labelled rows outside the held-out fold, or the
    share of class 1 where there are not both classes."""
    usable = labels.filter((fold(id_col, folds) != held_out) & F.col(label_col).isin(0, 1))
    sample = stratified_sample(usable, id_col, label_col, per_class)
    # at most 2 * per_class identifiers
    picked = docs.select(F.col(id_col), whole_text(F.col(text_col)).alias("_text")).join(
        F.broadcast(sample.select(id_col, label_col, "_weight")), id_col)
    told = picked.select("_text", F.concat_ws(" ", F.col(label_col).cast("string"),
                                              F.col("_weight").cast("string")).alias("_row"))
    got = sorted((r["_row"], bytes(r["idx"]), bytes(r["val"])) for r in _featurised(told).collect())
    y = np.array([float(r[0].split()[0]) for r in got])
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    weight = np.array([float(r[0].split()[1]) for r in got])
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, i, v in got]
    return FactorisationMachine().fit(rows, y, weight)


def score_quality(docs: DataFrame, model: FactorisationMachine | float, id_col: str = "doc_id",
                  text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Per document `_quality_score` and its identifier or, with
    `keep_columns`, the whole row as the struct `_doc`, so that no column of the
    documents can clash."""
    if keep_columns:
        src = docs.select(F.struct("*").alias("_doc"), whole_text(F.col(text_col)).alias("_quality_text"))
    else:
        src = docs.select(F.col(id_col), whole_text(F.col(text_col)).alias("_quality_text"))

    def run(batches):
        features = Features()
        for b in batches:
            texts = b.column("_quality_text")
            at = 0
            for ids, some in bounded(texts, texts):
                if isinstance(model, float):
                    scores = np.full(len(some), model)
                else:
                    rows = features(some)
                    sizes = np.array([len(i) for i, _ in rows])
                    raw, _ = model.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]),
                                       np.r_[0, np.cumsum(sizes)[:-1]])
                    scores = 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))
                part = b.slice(at, len(some))
                at += len(some)
                names = [n for n in b.schema.names if n != "_quality_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(scores, pa.float64())],
                                                 names=[*names, "_quality_score"])

    return src.mapInArrow(run, src.drop("_quality_text").schema.add("_quality_score", "double"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 3, held_out: int = 1,
            **kw) -> DataFrame:
    """Train on the labelled rows and score all: id, held_out, score, predicted."""
    model = train_quality(docs, labels, id_col, folds=folds, held_out=held_out, **kw)
    scored = score_quality(docs, model, id_col, kw.get("text_col", "text"))
    return scored.select(id_col, F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"),
                         F.col("_quality_score").alias("score"),
                         (F.col("_quality_score") >= 0.5).cast("int").alias("predicted"))
