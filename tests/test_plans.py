"""Plan shapes the scale design relies on (checked on small inputs)."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from askbatch.operators import exchange as X
from askbatch.operators import memo as M
from askbatch.operators.links import extract_links, resolve_links
from askbatch.operators.markdown import html_to_markdown
from askbatch.operators.retrieval import build_index, retrieve_topk
from askbatch.sources.pages import fetch_join, pick_pages
from askbatch.sources.search import scan_search_responses


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n")[0]


def explained(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _docs(spark):
    return spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common") for i in range(50)], "doc_id long, text string")


def test_scores_are_summed_inside_the_buckets(spark):
    qs = spark.createDataFrame([(1, "w1 common"), (2, "w2")], "qid long, query string")
    idx = build_index(_docs(spark)).materialize(block_docs=8)
    p = plan(retrieve_topk(qs, idx, k=3))
    # no exchange but that of the k rows per query and task, and broadcasts
    assert p.count("Exchange") - p.count("BroadcastExchange") == 1 and "SortMergeJoin" not in p
    assert p.count("WindowGroupLimit") == 2
    # pruned: one more such exchange, in the threshold, which is written first
    p = plan(retrieve_topk(qs, idx, k=3, prune=True))
    assert "ShuffledHashJoin" in p and "SortMergeJoin" not in p
    full = explained(retrieve_topk(qs, idx, k=3, prune=True))
    assert not re.search(r"hashpartitioning\((qid|lang|block)[^)]*doc_id", full)
    assert all(re.fullmatch(r"hashpartitioning\(qid#\d+L?(, lang#\d+)?, \d+\).*", x)
               for x in re.findall(r"hashpartitioning.*", full))


def test_market_prunes_language_partitions(spark):
    docs = _docs(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    qs = spark.createDataFrame([(1, "w1 common", "fr-fr"), (2, "w2", "fr-ca")], "qid long, query string, mkt string")
    idx = build_index(docs).materialize()
    df = retrieve_topk(qs, idx, k=3, mkt_col="mkt")
    assert "dynamicpruning" in explained(df)
    got = {r.doc_id for r in df.collect()}
    assert got and all(d % 2 == 1 for d in got)


def test_narrow_operators_have_no_exchange(spark):
    pages = spark.createDataFrame([("http://a/b", "<a href='x.pdf'>x</a>")], "url string, html string")
    resp = spark.createDataFrame([("page:1:0", 200, "{}")], "request_id string, status int, body string")
    searches = spark.createDataFrame([(1, 200, "{}")], "question_id long, status int, body string")
    for df in (html_to_markdown(pages), resolve_links(extract_links(pages)), X.parse_responses(resp),
               scan_search_responses(searches)):
        assert "Exchange" not in plan(df)


def test_no_page_text_moves_before_the_pick(spark):
    results = spark.createDataFrame([(1, 0, "http://a")], "question_id long, pos long, url string")
    pages = spark.createDataFrame([(1, "http://a", "<p>a</p>", 200)], "page_id long, url string, html string, status int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # whatever is shuffled has the columns of a pick, not the page
        picked = explained(pick_pages(results, pages))
        assert "hashpartitioning" in picked
        assert not [x for x in re.findall(r"Exchange.*\nInput \[\d+\]: \[(.*)\]", picked) if "html" in x]
        # under the limits the page texts meet the broadcast picks where they are
        p = plan(fetch_join(results, pages)[0])
        assert "BroadcastHashJoin Inner" in p and p.count("Exchange") == p.count("BroadcastExchange")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_repeated_crawls(spark):
    results = spark.createDataFrame([(1, i, f"http://{u}") for i, u in enumerate("abcde")], "question_id long, pos long, url string")
    pages = spark.createDataFrame(
        [(1, "http://a", "old", 200), (2, "http://a", "new", 200), (3, "http://b", "x", 200), (3, "http://b", "y", 200),
         (4, "http://c", "was", 200), (5, "http://c", "gone", 404), (6, "http://d", None, 200)],
        "page_id long, url string, html string, status int")
    fetched, failed = fetch_join(results, pages)
    assert sorted((r.pos, r.html) for r in fetched.collect()) == [(0, "new"), (1, "y")]
    assert sorted((r.key, r.reason) for r in failed.collect()) == [
        ("http://c", "http_status 404"), ("http://d", "http_status 200"), ("http://e", "not_fetched")]
    # without page ids a digest decides, the same on every run
    bare = pages.filter("url = 'http://a'").drop("page_id")
    assert len({fetch_join(results, bare.orderBy(F.rand()))[0].first().html for _ in range(2)}) == 1


def test_memo_lookup_and_merge_do_not_shuffle_the_store(spark):
    memo = spark.createDataFrame([("q", "a", 1)], "question string, answer string, ts long") \
        .select("question", "answer", F.timestamp_seconds("ts").alias("stored_at"))
    qs = spark.createDataFrame([(1, "q")], "question_id long, question string")
    hits, _ = M.memo_lookup(qs, memo)
    assert "BroadcastHashJoin LeftSemi" in plan(hits)
    merged = plan(M.memo_merge(memo, spark.createDataFrame([("q", "b")], "question string, answer string"),
                               unique_store=True))
    assert "BroadcastHashJoin LeftAnti" in merged and "BroadcastHashJoin LeftSemi" in merged
