"""BM25 top-k and passages against a brute-force Python computation."""

import math
import re
from collections import Counter

from askbatch.operators.retrieval import (B, K1, CorpusIndex, build_index, extract_passages, retrieve_topk,
                                         rows_per_hot_term, score_pairs, top_k)
from askbatch.session import scratch_path

DOCS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "cats and dogs and cats"),
        (4, "a cat a cat a cat"), (5, ""), (6, "Über große Straße, straße!"), (7, "the cat sat on the mat")]
QUERIES = [(10, "cat mat"), (11, "the"), (12, "straße"), (13, "zebra")]


def toks(s):
    return [t for t in re.split(r"[^\w]+|_", s.lower()) if t]


def brute(k):
    docs = {d: toks(t) for d, t in DOCS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for ts in docs.values() for t in set(ts))
    out = []
    for qid, q in QUERIES:
        scores = {}
        for d, ts in docs.items():
            tf = Counter(ts)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (K1 + 1)
                    / (tf[t] + K1 * (1 - B + B * len(ts) / avg)) for t in set(toks(q)) if tf[t])
            if any(tf[t] for t in set(toks(q))):
                scores[d] = s
        ranked = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out += [(qid, i + 1, d, round(s, 4)) for i, (d, s) in enumerate(ranked)]
    return sorted(out)


def _frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    qs = spark.createDataFrame(QUERIES, "qid long, query string")
    return docs, qs


def test_bm25_topk_matches_brute_force(spark):
    docs, qs = _frames(spark)
    got = sorted((r.qid, r.rank, r.doc_id, r.score) for r in retrieve_topk(qs, docs, k=3).collect())
    assert got == brute(3)


def test_query_blocks_and_pruning_agree(spark):
    docs, qs = _frames(spark)
    lazy = build_index(docs)
    for idx in (lazy.materialize(), lazy.materialize(block_docs=2, buckets=3)):
        whole = sorted((r.qid, r.doc_id, round(r.score, 9)) for r in score_pairs(qs, idx).collect())
        # one or two query terms at a time: several broadcast blocks
        blocks = sorted((r.qid, r.doc_id, round(r.score, 9)) for r in score_pairs(qs, idx, broadcast_rows=2).collect())
        assert whole == blocks and len(whole) > 0
        for k, rows, prune in ((3, 2, False), (1, 2_000_000, True), (3, 2, True)):
            got = retrieve_topk(qs, idx, k=k, broadcast_rows=rows, prune=prune)
            assert sorted((r.qid, r.rank, r.doc_id, r.score) for r in got.collect()) == brute(k)


def test_materialized_index_gives_same_ranking(spark):
    docs, qs = _frames(spark)
    idx = build_index(docs).materialize()
    got = sorted((r.qid, r.rank, r.doc_id, r.score) for r in retrieve_topk(qs, idx, k=3).collect())
    assert got == brute(3)


def test_mkt_keeps_one_language(spark):
    docs = spark.createDataFrame([(1, "cat", "en"), (2, "cat", "fr")], "doc_id long, text string, lang string")
    qs = spark.createDataFrame([(1, "cat")], "qid long, query string")
    got = [r.doc_id for r in retrieve_topk(qs, docs, k=5, mkt="fr-fr").collect()]
    assert got == [2]


def test_passages_best_line_by_overlap(spark):
    pairs = spark.createDataFrame([(1, 9, "intro\nthe cat\ncat on mat\nmat")], "qid long, doc_id long, text string")
    qs = spark.createDataFrame([(1, "cat mat")], "qid long, query string")
    r = extract_passages(pairs, qs, n=1).collect()
    assert [(x.line_no, x.overlap, x.passage) for x in r] == [(2, 2, "cat on mat")]
    two = extract_passages(pairs, qs, n=2).orderBy("line_no").collect()
    assert [x.line_no for x in two] == [1, 2]


def test_refine_moves_weak_queries_to_the_broad_index(spark):
    from askbatch.plans.answering import refine_answers
    docs = spark.createDataFrame([(1, "cat cat cat", "en"), (2, "chien chat", "fr"), (3, "dog", "en")],
                                 "doc_id long, text string, lang string")
    qs = spark.createDataFrame([(1, "cat"), (2, "chat"), (3, "zebra")], "qid long, query string")
    narrow, broad = build_index(docs, mkt="en-us"), build_index(docs)
    got = sorted((r.qid, r.doc_id, r.round) for r in refine_answers(qs, [narrow, broad], k=2, min_score=0.1).collect())
    # "cat" resolves on the English index; "chat" only on the full corpus; "zebra" nowhere
    assert got == [(1, 1, 1), (2, 2, 2)]


def test_per_query_market(spark):
    docs = spark.createDataFrame([(1, "cat", "en"), (2, "cat", "fr"), (3, "cat dog", "EN")],
                                 "doc_id long, text string, lang string")
    qs = spark.createDataFrame([(1, "cat", "fr-fr"), (2, "cat", "en-us"), (3, "cat", None)],
                               "qid long, query string, mkt string")
    idx = build_index(docs)
    for broadcast_rows in (2_000_000, 0):
        for prune in (False, True):
            got = sorted((r.qid, r.doc_id) for r in retrieve_topk(
                qs, idx, k=5, mkt_col="mkt", broadcast_rows=broadcast_rows, prune=prune).collect())
            assert got == [(1, 2), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3)]


def _real(spark, root="/root/testdata/sf0.01"):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang")
    qs = spark.read.parquet(f"{root}/benchmark.parquet").select(F.col("item_id").alias("qid"),
                                                                 F.col("text").alias("query"))
    return docs, qs


def test_pruning_on_real_corpus_with_hot_terms(spark):
    from pyspark.sql import functions as F
    docs, qs = _real(spark)
    idx = build_index(docs).materialize(block_docs=32)
    assert idx.terms.filter("hot").count() > 0
    best = top_k(score_pairs(qs, idx), 5)
    want = sorted((r.qid, r["rank"], r.doc_id, round(r.score, 4)) for r in best.collect())
    for kw in ({}, {"prune": True}, {"prune": True, "broadcast_rows": 200}):
        got = retrieve_topk(qs, idx, k=5, **kw)
        assert sorted((r.qid, r["rank"], r.doc_id, r.score) for r in got.collect()) == want
    # frequent terms are paired with fewer documents, and the count is reported
    report = rows_per_hot_term(qs, idx, k=5)
    held = {r.term: r.df for r in idx.terms.filter("hot").collect()}
    asked = Counter(t for r in qs.collect() for t in set(toks(r.query)))
    rows = report.collect()
    assert all(r.df == held[r.term] and r.pairs == held[r.term] * asked[r.term] for r in rows)
    assert all(r.pairs_read <= r.pairs for r in rows)
    assert sum(r.pairs_read for r in rows) < 0.9 * sum(r.pairs for r in rows)
    assert report.filter(F.col("pairs_read") < F.col("pairs")).count() > 0


def test_index_loads_with_its_buckets(spark):
    docs, qs = _frames(spark)
    path = scratch_path(spark, "idx-buckets")
    idx = build_index(docs).materialize(path, block_docs=2, buckets=5)
    assert CorpusIndex.exists(spark, path) and not CorpusIndex.exists(spark, path + "-other")
    again = CorpusIndex.load(spark, path)
    assert again.n_docs == len(DOCS)
    for i in (idx, again):
        assert sorted((r.qid, r.rank, r.doc_id, r.score) for r in retrieve_topk(qs, i, k=3).collect()) == brute(3)


def test_empty_corpus_and_queries(spark):
    docs, qs = _frames(spark)
    assert retrieve_topk(qs, docs.filter("false"), k=3).count() == 0
    assert retrieve_topk(qs.filter("false"), docs, k=3).count() == 0
    assert retrieve_topk(qs, docs.filter("false"), k=3, prune=True).count() == 0


def test_relaxed_search_drops_terms_until_a_page_holds_the_rest(spark):
    import contextlib
    import io
    from askbatch.operators.retrieval import relaxed_search
    docs = spark.createDataFrame([(1, "cat sat mat"), (2, "cat sat"), (3, "cat dog"), (4, "dog dog cow"), (5, "cat cat cat cow")],
                                 "doc_id long, text string")
    qs = spark.createDataFrame([(1, "cat sat mat"), (2, "sat dog cat"), (3, "mat cow dog cat"), (4, "zebra cat sat"), (5, "yak")],
                               "qid long, query string")
    idx = build_index(docs).materialize(block_docs=2)
    df = {t: sum(t in toks(x) for x in ("cat sat mat", "cat sat", "cat dog", "dog dog cow", "cat cat cat cow"))
          for t in ("cat", "sat", "mat", "dog", "cow")}
    held = {1: "cat sat mat", 2: "cat sat", 3: "cat dog", 4: "dog dog cow", 5: "cat cat cat cow"}
    for rounds in (0, 1, 9):
        want = {}
        for r in qs.collect():
            terms = sorted((t for t in toks(r.query) if t in df), key=lambda t: (df[t], t))
            for dropped in range(rounds + 1):
                left = terms[:len(terms) - dropped]
                hit = [d for d, x in held.items() if left and all(t in toks(x) for t in left)]
                if hit:
                    want[r.qid] = (dropped + 1, sorted(hit))
                    break
            else:
                hit = [d for d, x in held.items() if set(terms) & set(toks(x))]
                if hit:
                    want[r.qid] = (rounds + 2, sorted(hit))
        found = relaxed_search(qs, idx, k=5, rounds=rounds)
        got = {}
        for r in found.collect():
            got.setdefault(r.qid, (r["round"], []))[1].append(r.doc_id)
        assert {q: (n, sorted(d)) for q, (n, d) in got.items()} == want
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        found.explain()
    scans = [x for x in buf.getvalue().split("== Initial Plan ==")[0].splitlines() if "askbatch_postings" in x]
    assert len(scans) == 1          # all rounds share one scan of the postings
