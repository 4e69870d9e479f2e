"""Matrix scoring of a batch of queries against plain Python."""

import contextlib
import io
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from askbatch.operators import scoring
from askbatch.operators.retrieval import build_index, retrieve_topk


class Value:
    def __init__(self, value):
        self.value = value


def _case(ids, copies, seed):
    rng = random.Random(seed)
    terms = [(q, t, rng.random() + 0.1) for q in ["a", None, "b", "c"] for t in sorted(rng.sample(range(12), rng.randint(1, 6)))]
    held = [(d, t, rng.random() + 0.1) for d in ids for t in sorted(rng.sample(range(14), rng.randint(0, 9))) for _ in range(copies)]
    table = pa.table({"qid": pa.array([q for q, _, _ in terms]), "key": pa.array([t for _, t, _ in terms], pa.int64()),
                      "idf": pa.array([w for _, _, w in terms])})
    blocks = [[{"doc_id": d, "key": t, "part": p} for d, t, p in held if hash(str(d)) % 3 == b] for b in range(3)]
    kind = pa.string() if isinstance(ids[-1], str) else pa.int64()
    rows = pa.array(blocks, pa.list_(pa.struct([("doc_id", kind), ("key", pa.int64()), ("part", pa.float64())])))
    return terms, held, table, pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), rows, pa.array(["x"] * 3)], names=["block", "held", "lang"])


def _want(terms, held, k):
    out = []
    for q in {q for q, _, _ in terms}:
        scores = {}
        for d, t, p in held:
            for p2, t2, w in terms:
                if p2 == q and t2 == t:
                    scores[d] = scores.get(d, 0) + w * p
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0] is not None, x[0] if x[0] is not None else 0))[:k]
        out += [(q, d, round(s, 6)) for d, s in best]
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", [[None, *range(40)], ["zz", "é", "b", *map(str, range(20))]])
@pytest.mark.parametrize("copies", [1, 2])
def test_tiles_give_the_best_documents(monkeypatch, ids, copies):
    monkeypatch.setattr(scoring, "PAIRS", 7)
    for seed, tile, share in ((1, 3, 1 / 64), (2, 5, 0.5), (3, 1024, 2.0)):
        monkeypatch.setattr(scoring, "TILE", tile)
        monkeypatch.setattr(scoring, "DENSE_SHARE", share)
        terms, held, table, batch = _case(ids, copies, seed)
        for k in (1, 4, 100):
            got = pa.Table.from_batches(scoring.topk_task(Value(scoring.Queries(table)), k)([batch])).to_pylist()
            assert sorted(((r["qid"], r["doc_id"], round(r["score"], 6)) for r in got), key=str) == _want(terms, held, k)


def test_many_copies_keep_the_smallest_identifiers():
    held = [[{"doc_id": d, "key": 5, "part": 1.0} for d in range(3000)]]
    rows = pa.array(held, pa.list_(pa.struct([("doc_id", pa.int64()), ("key", pa.int64()), ("part", pa.float64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), rows], names=["block", "held"])
    queries = scoring.Queries(pa.table({"qid": [1, 2], "key": [5, 9], "idf": [1.0, 1.0]}))
    got = pa.Table.from_batches(scoring.topk_task(Value(queries), 3)([batch]))
    assert got["doc_id"].to_pylist() == [0, 1, 2] and got["qid"].to_pylist() == [1, 1, 1]


@pytest.mark.parametrize("copies", [1, 2])
@pytest.mark.parametrize("rounds", [0, 2, 9])
def test_rounds_of_dropped_terms(monkeypatch, copies, rounds):
    monkeypatch.setattr(scoring, "FEW", 2)
    terms, held, table, batch = _case(list(range(40)), copies, 4)
    nth = [sum(q == p and t2 <= t for p, t2, _ in terms) for q, t, _ in terms]
    queries = scoring.Queries(table.append_column("nth", pa.array(nth)))
    got = pa.Table.from_batches(scoring.relaxed_task(Value(queries), 5, rounds, whole=False)([batch])).to_pylist()
    for q in {q for q, _, _ in terms}:
        place = {t: n for (p, t, _), n in zip(terms, nth, strict=True) if p == q}
        weight = {t: w for p, t, w in terms if p == q}
        found = []
        for d in range(40):
            g = sorted((place[t], weight[t] * p) for d2, t, p in held if d2 == d and t in place)
            if g:
                lead = sum(n == i + 1 for i, (n, _) in enumerate(g))
                proper = len(place) - lead <= rounds
                found.append((len(place) - lead + 1 if proper else rounds + 2,
                              -round(sum(p for _, p in (g[:lead] if proper else g)), 6), d))
        found = [x for x in sorted(found)[:5] if x[0] == min(found)[0]]
        mine = sorted((r["round"], -round(r["score"], 6), r["doc_id"]) for r in got if r["qid"] == q)[:5]
        assert [x for x in mine if x[0] == mine[0][0]] == found


def test_no_row_per_query_and_document(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} common") for i in range(50)], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "w1 common")], "qid long, query string")
    idx = build_index(docs).materialize(block_docs=8)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        retrieve_topk(qs, idx, k=3).explain("formatted")
    assert not re.search(r"Keys \[\d+\]: \[qid[^\]]*doc_id", buf.getvalue())
    assert np.isclose(retrieve_topk(qs, idx, k=3, prune=True).agg({"score": "sum"}).first()[0],
                      retrieve_topk(qs, idx, k=3).agg({"score": "sum"}).first()[0])


def test_index_exchanges_terms_as_one_text(spark, tmp_path, monkeypatch):
    from askbatch.operators import retrieval
    seen = []
    write = retrieval._write_bucketed
    monkeypatch.setattr(retrieval, "_write_bucketed", lambda rows, *a: (seen.append(rows), write(rows, *a)))
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c " * 40_000 + "é")], "doc_id long, text string")
    idx = build_index(docs).materialize(str(tmp_path / "idx"))
    assert sorted((r.doc_id, r.term) for r in idx.postings.collect()) == [(1, "a"), (1, "b"), (4, "c"), (4, "é")]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        seen[0].explain("formatted")
    assert "array_join" in buf.getvalue()       # no array of structs travels
    assert list((tmp_path / "idx" / "docs").glob("*.zstd.parquet"))


def test_postings_of_a_batch_are_copied_few_times():
    docs, terms = 1500, 200
    held = pa.StructArray.from_arrays(
        [pa.array(np.repeat(np.arange(docs), terms)), pa.array(np.tile(np.arange(terms) * 7, docs)),
         pa.array(np.random.default_rng(1).random(docs * terms))], names=["doc_id", "key", "part"])
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.ListArray.from_arrays(pa.array([0, docs * terms], pa.int32()), held)],
                                       names=["block", "held"])
    queries = scoring.Queries(pa.table({"qid": np.arange(terms), "key": np.arange(terms) * 7, "idf": np.ones(terms)}))
    tracemalloc.start()
    try:
        made = scoring.Documents(batch, queries)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(made.doc) == docs * terms and (made.doc * terms + made.term == made.place).all()
    assert kept < 30 * docs * terms and peak < 60 * docs * terms
