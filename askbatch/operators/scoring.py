"""Scores of a batch of queries inside a task, as matrices.

A task meets the postings of its documents block by block (`held`, a list of
document, term key and part) and yields the k best documents of every query
among those of one Arrow batch, so no row per query and document ever exists.
Documents and queries meet in tiles: of a tile's terms, the common ones are
multiplied as dense matrices, the others pair by pair. Memory is bounded by a
tile, the Arrow batch and the batch of queries, not by their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# queries and documents of a tile, pairs formed at once
TILE = 1024
PAIRS = 1 << 20
# queries whose terms are followed one by one at once
FEW = 64
# a term is multiplied densely when it fills more than this share of a tile
DENSE_SHARE = 1 / 64
# scores are compared after rounding to this many units
UNITS = 1e6


def _units(score: np.ndarray) -> np.ndarray:
    return np.floor(score * UNITS + 0.5).astype(np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start .. start + count - 1 of every pair, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class _ByTerm:
    """Entries (term, row, weight) grouped by term; rows count from 0."""

    def __init__(self, term: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int):
        order = np.argsort(term, kind="stable")
        self.row, self.weight, self.rows = row[order], weight[order], rows
        self.terms, self.starts, self.counts = np.unique(term[order], return_index=True, return_counts=True)

    def dense(self, at: np.ndarray) -> np.ndarray:
        """(terms, rows) of the terms at these places; repeats add up."""
        counts = self.counts[at]
        i = _ranges(self.starts[at], counts)
        cell = np.repeat(np.arange(len(at)), counts) * self.rows + self.row[i]
        return np.bincount(cell, self.weight[i], len(at) * self.rows).reshape(len(at), self.rows)


def _product(queries: _ByTerm, docs: _ByTerm) -> np.ndarray:
    """(queries, documents): sums of the products over shared terms."""
    _, a, b = np.intersect1d(queries.terms, docs.terms, assume_unique=True, return_indices=True)
    size = queries.rows * docs.rows
    work = queries.counts[a] * docs.counts[b]
    common = work > DENSE_SHARE * size
    if common.any():
        out = (queries.dense(a[common]).T @ docs.dense(b[common])).ravel()
    else:
        out = np.zeros(size)
    a, b, work = a[~common], b[~common], work[~common]
    # a term's work is under a share of a tile, so groups are bounded
    group = np.cumsum(work) // PAIRS
    for g in np.unique(group):
        x, y = a[group == g], b[group == g]
        nd = docs.counts[y]
        i = _ranges(docs.starts[y], nd)
        nq = np.repeat(queries.counts[x], nd)
        j = _ranges(np.repeat(queries.starts[x], nd), nq)
        i = np.repeat(i, nq)
        out += np.bincount(queries.row[j] * docs.rows + docs.row[i], queries.weight[j] * docs.weight[i], size)
    return out.reshape(queries.rows, docs.rows)


class _Best:
    """The k best (query, round, score, document), ties to the earlier document."""

    def __init__(self, k: int):
        self.k = k
        self.q = self.d = self.round = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, q, d, score, round_=0) -> None:
        q, d = np.concatenate([self.q, q]), np.concatenate([self.d, d])
        score = np.concatenate([self.score, score])
        round_ = np.concatenate([self.round, np.broadcast_to(round_, len(q) - len(self.q))])
        order = np.lexsort((d, -_units(score), round_, q))
        q = q[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = nth < self.k
        order = order[keep]
        self.q, self.d, self.score, self.round = q[keep], d[order], score[order], round_[order]

    def floor(self, queries: int) -> np.ndarray:
        """What a later document has to score at least to come in."""
        out = np.zeros(queries)
        counts = np.bincount(self.q, minlength=queries)
        full = np.flatnonzero(counts >= self.k)
        last = np.cumsum(counts)[full] - 1
        out[full] = (_units(self.score[last]) + 0.5) / UNITS - 1e-9
        return out


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The values as numbers of a dictionary; null is a value."""
    ids = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    ids = ids.dictionary_encode(null_encoding="encode")
    return ids.indices.to_numpy().astype(np.int64), ids.dictionary


class Queries:
    """Query terms as arrays: a row per query and term key with its weight;
    `nth`, its place among the query's terms, from 1; `late` and `floor` of a
    pruned search; `hot` for the terms that a threshold leaves out at first."""

    def __init__(self, terms: pa.Table):
        def column(name, empty):
            return terms[name].to_numpy() if name in terms.column_names else empty

        n = len(terms)
        q, self.ids = _codes(terms["qid"])
        if "lang" in terms.column_names:        # a query counts anew in each language
            lang, langs = _codes(terms["lang"])
            seen, q = np.unique(q * max(len(langs), 1) + lang, return_inverse=True)
            self.ids = self.ids.take(pa.array(seen // max(len(langs), 1)))
        key = terms["key"].to_numpy()
        once = np.lexsort((key, q))
        self.q = q[once]
        self.keys, self.term = np.unique(key[once], return_inverse=True)
        self.idf = column("idf", None)[once]
        self.nth = column("nth", np.zeros(n, np.int64))[once].astype(np.int64)
        self.terms = np.bincount(self.q, minlength=len(self.ids))
        self.late = column("late", np.zeros(n, bool))[once].astype(bool)
        self.hot = column("hot", np.zeros(n, bool))[once].astype(bool)
        self.floors = np.full(len(self.ids), np.nan)
        if "floor" in terms.column_names:
            self.floors[self.q] = terms["floor"].cast(pa.float64()).to_numpy()[once]

    def __len__(self) -> int:
        return len(self.ids)

    def tile(self, start: int, stop: int, some: np.ndarray | None = None) -> _ByTerm:
        # rows stand in the order of their query
        a, b = np.searchsorted(self.q, [start, stop])
        mine = np.arange(a, b) if some is None else a + np.flatnonzero(some[a:b])
        return _ByTerm(self.term[mine], self.q[mine] - start, self.idf[mine], stop - start)


class Documents:
    """The postings of one Arrow batch; documents in ascending order of their
    identifier (and, with `by_lang`, their language)."""

    def __init__(self, batch: pa.RecordBatch, queries: Queries, by_lang: bool = False):
        held = batch.column("held")
        doc_id, key, part = held.flatten().flatten()
        ids = doc_id.dictionary_encode(null_encoding="encode")
        order = pc.array_sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = rank[ids.indices.to_numpy()]
        row = np.repeat(np.arange(len(batch)), held.value_lengths().to_numpy())
        if by_lang:
            lang = batch.column("lang").dictionary_encode(null_encoding="encode").indices.to_numpy()
            doc = doc * (int(lang.max(initial=0)) + 1) + lang[row]
            seen, doc = np.unique(doc, return_inverse=True)
            order = order[seen // (int(lang.max(initial=0)) + 1)]
        self.ids = ids.dictionary.take(pa.array(order))
        self.row_of = np.zeros(len(self.ids), np.int64)     # the row (block) that a document came in
        self.row_of[doc] = row
        del row, ids
        key = key.to_numpy()
        self.vocabulary = len(queries.keys)
        # a batch has millions of postings: few arrays of that length at a time
        place = np.searchsorted(queries.keys, key)
        np.minimum(place, max(self.vocabulary - 1, 0), out=place)
        known = queries.keys[place] == key if self.vocabulary else np.zeros(len(key), bool)
        part = part.to_numpy()
        if not known.all():
            doc, place, part = doc[known], place[known], part[known]
        doc *= self.vocabulary
        place += doc
        del key, known, doc
        order = np.argsort(place, kind="stable")
        self.place, self.part = place[order], part[order]
        del place, order
        self.doc = self.place // max(self.vocabulary, 1)
        self.term = (self.place % max(self.vocabulary, 1)).astype(np.int32)
        self._by_term = None

    def __len__(self) -> int:
        return len(self.ids)

    def tiles(self, without: np.ndarray | None = None) -> list[tuple[int, int, _ByTerm]]:
        out = []
        for start in range(0, len(self), TILE):
            stop = min(start + TILE, len(self))
            a, b = np.searchsorted(self.doc, [start, stop])
            mine = np.arange(a, b) if without is None else a + np.flatnonzero(~without[self.doc[a:b]])
            out.append((start, stop, _ByTerm(self.term[mine], self.doc[mine] - start, self.part[mine], stop - start)))
        return out

    def parts(self, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a term gives a document in all, and whether it is there."""
        want = doc * self.vocabulary + term
        a, b = np.searchsorted(self.place, want), np.searchsorted(self.place, want, "right")
        sums = np.r_[0.0, self.part][np.where(b > a, a + 1, 0)]
        more = np.flatnonzero(b - a > 1)
        if len(more):
            n = (b - a)[more]
            sums[more] = np.bincount(np.repeat(np.arange(len(more)), n), self.part[_ranges(a[more], n)])
        return sums, b > a

    def by_term(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the postings by term, and where each term begins."""
        if self._by_term is None:
            order = np.argsort(self.term, kind="stable")
            self._by_term = order, np.searchsorted(self.term[order], np.arange(self.vocabulary + 1))
        return self._by_term

    def repeated(self) -> np.ndarray:
        """The documents that hold a term in more than one row."""
        out = np.zeros(len(self), bool)
        out[self.doc[1:][self.place[1:] == self.place[:-1]]] = True
        return out


def _scores_of(pairs_q: np.ndarray, pairs_d: np.ndarray, queries: Queries, docs: Documents,
               some: np.ndarray | None = None) -> np.ndarray:
    """The score of each pair by the query terms (those of `some`)."""
    out = np.zeros(len(pairs_q))
    a, b = np.searchsorted(queries.q, pairs_q), np.searchsorted(queries.q, pairs_q, "right")
    step = max(1, PAIRS // int((b - a).max(initial=1)))
    for at in range(0, len(pairs_q), step):
        x, n = a[at:at + step], (b - a)[at:at + step]
        i, pair = _ranges(x, n), np.repeat(np.arange(at, at + len(x)), n)
        if some is not None:
            i, pair = i[some[i]], pair[some[i]]
        part, _ = docs.parts(pairs_d[pair], queries.term[i])
        out += np.bincount(pair, queries.idf[i] * part, len(out))
    return out


def _candidates(score: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Cells of a tile that may be among a query's k best."""
    mask = (score > 0) & (score >= low[:, None])
    if mask.sum() > 4 * k * len(score) and score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        mask &= score >= (kth - 2 / UNITS)[:, None]
    return mask


def _top(queries: Queries, docs: Documents, k: int, some: np.ndarray | None = None,
         without: np.ndarray | None = None, only: np.ndarray | None = None, flat: bool = False) -> Iterator[_Best]:
    """The k best of all documents by the query terms (those of `some`), tile
    of queries by tile; `only` these queries, `without` these documents. With
    `flat` every document that shares a term counts alike."""
    tiles = docs.tiles(without)
    for start in range(0, len(queries), TILE):
        stop = min(start + TILE, len(queries))
        if only is not None and not only[start:stop].any():
            continue
        mine = queries.tile(start, stop, some if only is None else only[queries.q] & (some if some is not None else True))
        best = _Best(k)
        for first, _, held in tiles:
            score = _product(mine, held)
            if flat:
                score = (score > 0) * 1.0
            q, d = np.nonzero(_candidates(score, best.floor(stop - start), k))
            best.add(q, d + first, score[q, d])
        best.q = best.q + start
        yield best


def _pruned(queries: Queries, docs: Documents, tops: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: int,
            k: int) -> Iterator[_Best]:
    """As `_top`, but late terms are met only by the documents that may still
    reach the floor of their query by the maxima of their block."""
    tiles = docs.tiles()
    repeated = docs.repeated()      # may exceed the maxima of their block
    row, term, top = tops
    block_tops = _ByTerm(term, row, top, blocks)
    late_terms = np.bincount(queries.q, queries.late, len(queries)) if len(queries) else np.zeros(0)
    for start in range(0, len(queries), TILE):
        stop = min(start + TILE, len(queries))
        mine, late = queries.tile(start, stop, ~queries.late), queries.tile(start, stop, queries.late)
        bound = _product(late, block_tops)
        floors = queries.floors[start:stop]
        floors = np.where(np.isnan(floors), 0.0, floors - 4 / UNITS)    # scores are ranked rounded
        best = _Best(k)
        for first, last, held in tiles:
            score = _product(mine, held)
            low = np.maximum(best.floor(stop - start), floors)
            may = (score > 0) & (score + bound[:, docs.row_of[first:last]] >= low[:, None]) | repeated[first:last]
            q, d = np.nonzero(may)
            if late_terms[start + q].sum() * 8 > score.size:
                got = score[q, d] + _product(late, held)[q, d]
            else:
                got = score[q, d] + _scores_of(q + start, d + first, queries, docs, queries.late)
            best.add(q[got > 0], d[got > 0] + first, got[got > 0])
        best.q = best.q + start
        yield best


def _expanded(queries: Queries, docs: Documents, start: int, stop: int, which: np.ndarray, rounds: int) -> Iterator[tuple]:
    """(query, document, score, round) of these queries and documents, whose
    rows may hold a term several times: every row of a term counts."""
    a, b = np.searchsorted(queries.q, [start, stop])
    mine = _ByTerm(queries.term[a:b], np.arange(a, b), queries.idf[a:b], 0)
    for at in range(0, len(which), TILE):
        i = np.flatnonzero(np.isin(docs.doc, which[at:at + TILE]))
        slot = np.minimum(np.searchsorted(mine.terms, docs.term[i]), len(mine.terms) - 1)
        hit = mine.terms[slot] == docs.term[i]
        i, slot = i[hit], slot[hit]
        n = mine.counts[slot]
        j = mine.row[_ranges(mine.starts[slot], n)]
        i = np.repeat(i, n)
        q, d, nth, part = queries.q[j], docs.doc[i], queries.nth[j], queries.idf[j] * docs.part[i]
        order = np.lexsort((part, nth, d, q))
        q, d, nth, part = q[order], d[order], nth[order], part[order]
        if not len(q):
            continue
        starts = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (d[1:] != d[:-1])])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(q)]))
        place = np.arange(len(q)) - starts[group]
        lead = np.bincount(group, nth == place + 1).astype(np.int64)
        terms = queries.terms[q[starts]]
        proper = terms - lead <= rounds
        counted = ~proper[group] | (place < lead[group])
        yield q[starts], d[starts], np.bincount(group, part * counted), np.where(proper, terms - lead + 1, rounds + 2)


def _leading(queries: Queries, docs: Documents, start: int, stop: int, without: np.ndarray) -> tuple:
    """(query, document, leading terms, their score) of the documents that
    hold the first term of a query."""
    by_term, starts = docs.by_term()
    a, b = np.searchsorted(queries.q, [start, stop])
    order = a + np.lexsort((queries.nth[a:b], queries.q[a:b]))      # a query's terms in turn
    begin = np.searchsorted(queries.q[a:b], np.arange(start, stop))
    terms = queries.terms[start:stop]
    term = queries.term[order[begin]]
    n = starts[term + 1] - starts[term]
    i = by_term[_ranges(starts[term], n)]
    q = np.repeat(np.arange(start, stop), n)
    q, i = q[~without[docs.doc[i]]], i[~without[docs.doc[i]]]
    d, score = docs.doc[i], docs.part[i] * queries.idf[order[begin[q - start]]]
    lead, alive = np.ones(len(q), np.int64), np.arange(len(q))
    while len(alive):
        alive = alive[lead[alive] < terms[q[alive] - start]]
        at = order[np.minimum(begin[q[alive] - start] + lead[alive], max(b - a - 1, 0))]
        part, there = docs.parts(d[alive], queries.term[at])
        alive, at, part = alive[there], at[there], part[there]
        score[alive] += queries.idf[at] * part
        lead[alive] += 1
    return q, d, lead, score


def _relaxed(queries: Queries, docs: Documents, k: int, rounds: int, whole: bool) -> Iterator[_Best]:
    """The k best by round, then score. With `whole` every term is held by a
    document that the query may read."""
    repeated = docs.repeated()
    which = np.flatnonzero(repeated)
    found = np.zeros(len(queries), bool)
    for start in range(0, len(queries), FEW):
        stop = min(start + FEW, len(queries))
        best = _Best(k)
        q, d, lead, score = _leading(queries, docs, start, stop, repeated)
        dropped = queries.terms[q] - lead
        proper = dropped <= rounds
        best.add(q[proper], d[proper], score[proper], dropped[proper] + 1)
        for got in _expanded(queries, docs, start, stop, which, rounds):
            best.add(*got)
        found[best.q[best.round <= np.minimum(queries.terms[best.q], rounds + 1)]] = True
        yield best
    # without the first term: nothing counts while dropping goes on, then all does
    none = ~found & (queries.terms <= rounds)
    if none.any() and not whole:
        for got in _top(queries, docs, k, without=repeated, only=none, flat=True):
            got.score, got.round = np.zeros(len(got.q)), queries.terms[got.q] + 1
            yield got
    rest = ~found & (queries.terms > rounds) & ~((queries.terms == rounds + 1) & whole)
    if rest.any():
        for got in _top(queries, docs, k, without=repeated, only=rest):
            got.round = np.full(len(got.q), rounds + 2)
            yield got


def _rows(best: _Best, queries: Queries, docs: Documents, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"qid": queries.ids.take(pa.array(best.q)), "doc_id": docs.ids.take(pa.array(best.d)),
               "score": pa.array(best.score, pa.float64())}
    columns |= {name: pa.array(x) for name, x in more.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def topk_task(queries, k: int) -> Callable:
    """(qid, doc_id, score) for `mapInArrow`; `queries` is a broadcast."""
    def run(batches):
        mine = queries.value
        for b in batches:
            docs = Documents(b, mine)
            for best in _top(mine, docs, k):
                yield _rows(best, mine, docs)
    return run


def threshold_task(queries, k: int) -> Callable:
    """(qid, doc_id, score, full): the best by rare terms, and their whole score."""
    def run(batches):
        mine = queries.value
        for b in batches:
            docs = Documents(b, mine, by_lang=True)
            for best in _top(mine, docs, k, some=~mine.hot):
                yield _rows(best, mine, docs, full=_scores_of(best.q, best.d, mine, docs))
    return run


def pruned_task(queries, k: int) -> Callable:
    """As `topk_task`; the rows also hold `tops`, the maxima of their block."""
    def run(batches):
        mine = queries.value
        for b in batches:
            docs = Documents(b, mine, by_lang=True)
            tops = b.column("tops")
            key, top = (x.to_numpy() for x in tops.flatten().flatten())
            row = np.repeat(np.arange(len(b)), tops.value_lengths().fill_null(0).to_numpy())
            at = np.minimum(np.searchsorted(mine.keys, key), max(len(mine.keys) - 1, 0))
            known = mine.keys[at] == key if len(mine.keys) else np.zeros(len(key), bool)
            for best in _pruned(mine, docs, (row[known], at[known], top[known]), len(b), k):
                yield _rows(best, mine, docs)
    return run


def relaxed_task(queries, k: int, rounds: int, whole: bool) -> Callable:
    """(qid, doc_id, score, round) for `mapInArrow`."""
    def run(batches):
        mine = queries.value
        for b in batches:
            docs = Documents(b, mine, by_lang=True)
            for best in _relaxed(mine, docs, k, rounds, whole):
                yield _rows(best, mine, docs, round=best.round)
    return run
