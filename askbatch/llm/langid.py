"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy.

A document is the average of the embeddings of its subwords: the character
n-grams (1 to 4) of each lower-cased word between boundary marks, hashed into
buckets. As average and output layer are both linear, a trained model is folded
into one row of class scores per bucket, and a distinct word into the sum over
its subwords, kept in a bounded cache. Probabilities are calibrated by a
temperature fitted on a part of the sample that training did not see; a
document is `accepted` when its probability reaches the quantile `reject_rate`
of that part's probabilities.

The sample is bounded: at most `per_class` documents of each language,
identifiers first, texts only for those.

Edge cases: null text or text without a letter gets `und` with score 0, not
accepted; null languages teach nothing; without any labelled document all are
`und`; with one language only it is predicted for every text with a letter.
Repeated rows are scored each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bounded
from .learning import fold, stratified_sample

BUCKETS, DIMS = 1 << 16, 16
NGRAMS = (1, 2, 3, 4)
PER_CLASS = 800
CACHE_WORDS = 300_000
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
MARK = 1    # code point of the boundary mark


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram of the marked words."""
    flat = np.frombuffer(("\x01" + "\x01\x01".join(words) + "\x01").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    buckets, owner = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1:n - 1 + m] + np.uint64(n)
        if n not in NGRAMS:
            continue
        inside = word[:m] == word[n - 1:]
        mixed = h[inside]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[:m][inside])
    return np.concatenate(buckets), np.concatenate(owner)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs that hold a letter."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


@dataclass
class LanguageModel:
    languages: list[str]
    folded: np.ndarray          # buckets x languages
    bias: np.ndarray
    temperature: float
    accept_from: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / counts[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of a whole text and their shares."""
    words = words_of(text)
    found, counts = np.unique(subwords(words)[0], return_counts=True) if words else (np.zeros(0, np.int64), np.zeros(0))
    return found.astype(np.int64), (counts / max(1, counts.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 5, batch: int = 32, rate: float = 0.1,
          reject_rate: float = 0.01, seed: int = 7) -> LanguageModel | None:
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    usable = np.array([i for i, b in enumerate(bags) if len(b[0])], int)
    order = rng.permutation(usable)
    held = order[:len(order) // 5] if len(order) >= 5 * len(names) else order
    learn = order[len(order) // 5:] if len(order) >= 5 * len(names) else order
    e = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    w, bias = rng.normal(0, 0.3, (DIMS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)

    def forward(some):
        idx = np.concatenate([bags[i][0] for i in some])
        val = np.concatenate([bags[i][1] for i in some])
        sizes = np.array([len(bags[i][0]) for i in some])
        mean = np.add.reduceat(e[idx] * val[:, None], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
        z = mean @ w + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return idx, val, sizes, mean, z, p / p.sum(axis=1, keepdims=True)

    squares_e, squares_w, squares_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(w, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            some = learn[at:at + batch]
            idx, val, sizes, mean, _, p = forward(some)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            seen, back = np.unique(idx, return_inverse=True)
            g = np.repeat(p @ w.T, sizes, axis=0) * val[:, None]
            ge = np.stack([np.bincount(back, g[:, d], len(seen)) for d in range(DIMS)], axis=1)
            gw, gb = mean.T @ p, p.sum(axis=0)
            # steps scaled by past gradients: one scale per bucket and per output weight
            squares_e[seen] += (ge * ge).mean(axis=1)
            squares_w += gw * gw
            squares_b += gb * gb
            e[seen] -= (rate * ge / np.sqrt(squares_e[seen])[:, None]).astype(np.float32)
            w -= rate * gw / np.sqrt(squares_w)
            bias -= 0.1 * rate * gb / np.sqrt(squares_b)
    if not len(usable):
        return None
    z = np.concatenate([forward(held[i:i + 256])[4] for i in range(0, len(held), 256)])
    nll = {t: float(np.mean(np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1))
                            - (z[np.arange(len(held)), y[held]] - z.max(1)) / t)) for t in np.geomspace(0.05, 5, 40)}
    model = LanguageModel(names, e @ w, bias, float(min(nll, key=nll.get)), 0.0)
    probabilities = model.probabilities(z - bias, np.ones(len(z))).max(axis=1)
    model.accept_from = float(np.quantile(probabilities, reject_rate))
    return model


class Scorer:
    """Documents to (language, probability, accepted)."""

    def __init__(self, model: LanguageModel):
        self.model, self.ids = model, {}
        self.table = np.zeros((1 << 12, len(model.languages) + 1))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids.clear()
            new = list(words)
        if not new:
            return
        at = len(self.ids)
        while at + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        bucket, owner = subwords(new)
        rows = self.table[at:at + len(new)]
        for k in range(len(self.model.languages)):
            rows[:, k] = np.bincount(owner, self.model.folded[bucket, k], len(new))
        rows[:, -1] = np.bincount(owner, minlength=len(new))
        self.ids.update(zip(new, range(at, at + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        split = [words_of(t) for t in texts]
        distinct: set[str] = set()
        for s in split:
            distinct.update(s)
        self._learn(distinct)
        out = [(UNDETERMINED, 0.0, False)] * len(texts)
        full = [i for i, s in enumerate(split) if s]
        if full:
            sums = np.stack([self.table[np.fromiter(map(self.ids.__getitem__, split[i]), np.int64, len(split[i]))].sum(axis=0)
                             for i in full])
            p = self.model.probabilities(sums[:, :-1], sums[:, -1])
            for i, k, s in zip(full, p.argmax(axis=1), p.max(axis=1), strict=True):
                out[i] = (self.model.languages[k], float(s), bool(s >= self.model.accept_from))
        return out


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS, **kw) -> LanguageModel | None:
    """A model of at most `per_class` documents a language. Their bags are
    computed on the executors; a bag has at most BUCKETS entries."""
    usable = docs.filter((fold(id_col, folds) != held_out) & F.col(text_col).isNotNull())
    sample = stratified_sample(usable, id_col, lang_col, per_class)
    rows = (usable.select(id_col, lang_col, text_col)
            .join(F.broadcast(sample.select(id_col, lang_col)), [id_col, lang_col])
            .select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")))

    def run(batches):
        for b in batches:
            for langs, texts in bounded(b.column("l"), b.column("t")):
                bags = [bag(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [langs, pa.array([i.tobytes() for i, _ in bags], pa.binary()),
                     pa.array([v.tobytes() for _, v in bags], pa.binary())], names=["l", "idx", "val"])
    got = sorted((r["l"], bytes(r["idx"]), bytes(r["val"]))
                 for r in rows.mapInArrow(run, "l string, idx binary, val binary").collect())
    return train([(np.frombuffer(i, np.int64), np.frombuffer(v, np.float32)) for _, i, v in got], [x for x, _, _ in got], **kw)


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score, accepted."""
    src = docs.select(F.col(id_col), F.col(text_col).alias("_lang_text"))

    def run(batches):
        scorer = Scorer(model) if model else None
        for b in batches:
            for ids, texts in bounded(b.column(0), b.column(1)):
                rows = scorer(texts) if scorer else [(UNDETERMINED, 0.0, False)] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                     pa.array([r[2] for r in rows], pa.bool_())], names=[id_col, "lang_pred", "score", "accepted"])

    schema = (src.select(id_col).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean"))
    return src.mapInArrow(run, schema)


def languages(docs: DataFrame, id_col: str = "doc_id", folds: int = 4, held_out: int = 2, **kw) -> DataFrame:
    """Train outside the held-out fold, predict all: id, held_out, lang_pred,
    score, accepted."""
    model = train_languages(docs, id_col, folds=folds, held_out=held_out, **kw)
    return identify_languages(docs, model, id_col, kw.get("text_col", "text")).select(
        id_col, F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "accepted")
