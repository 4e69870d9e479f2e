"""Search responses (F1, F2, F8), fetch join (F9) and the listing."""

import pytest
from pyspark.sql import functions as F

from askbatch.operators.listing import results_listing
from askbatch.operators.markdown import html_to_markdown
from askbatch.sources.pages import fetch_join
from askbatch.sources.search import scan_search_responses, search_failures

SCHEMA = "question_id long, status int, body string"
F1_BODY = '{"webPages":{"value":[{"url":"http://example.com","name":"Example","snippet":"Test"}]}}'


def test_f1_one_result_without_id(spark):
    df = spark.createDataFrame([(1, 200, F1_BODY)], SCHEMA)
    rows = scan_search_responses(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.question_id, r.pos, r.id, r.name, r.url, r.snippet) == (1, 0, None, "Example", "http://example.com", "Test")
    assert search_failures(df).count() == 0


def test_f2_404_is_a_failure_not_results(spark):
    df = spark.createDataFrame([(2, 404, None)], SCHEMA)
    assert scan_search_responses(df).count() == 0
    f = search_failures(df).collect()
    assert [(x.stage, x.key, x.reason) for x in f] == [("search", "404", "http_status")]


def test_f8_every_bad_shape_has_one_reason(spark):
    cases = [(1, 200, '{"webPages":{"value":[]}}'), (2, 200, '{"webPages":{}}'), (3, 200, "{}"),
             (4, 200, "not json"), (5, 200, ""), (6, 200, None), (7, 500, F1_BODY)]
    df = spark.createDataFrame(cases, SCHEMA)
    reasons = {r.question_id: r.reason for r in search_failures(df).collect()}
    assert reasons == {2: "no_value", 3: "empty_response", 4: "bad_json", 5: "bad_json",
                       6: "bad_json", 7: "http_status"}
    # an empty result list is not a failure, it just has no rows
    assert scan_search_responses(df).count() == 0


def test_positions_follow_the_response_order(spark):
    body = '{"webPages":{"value":[{"id":"a","url":"u1"},{"id":"b","url":"u2"},{"id":"c","url":"u3"}]}}'
    df = spark.createDataFrame([(9, 200, body)], SCHEMA)
    got = [(r.pos, r.id) for r in scan_search_responses(df).orderBy("pos").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_f9_fetch_join_missing_and_bad_status(spark):
    results = spark.createDataFrame(
        [(1, 0, "http://a"), (1, 1, "http://missing"), (1, 2, "http://bad")],
        "question_id long, pos long, url string")
    pages = spark.createDataFrame(
        [(10, "http://a", "<p>a</p>", 200), (11, "http://bad", "<p>x</p>", 500)],
        "page_id long, url string, html string, status int")
    fetched, failures = fetch_join(results, pages)
    assert [(r.pos, r.url) for r in fetched.collect()] == [(0, "http://a")]
    fails = sorted((r.key, r.reason) for r in failures.collect())
    assert fails == [("http://bad", "http_status 500"), ("http://missing", "not_fetched")]
    # invariant: results = fetched + failures
    assert fetched.count() + failures.count() == results.count()


def test_fetch_join_duplicate_crawl_keeps_newest(spark):
    results = spark.createDataFrame([(1, 0, "http://a")], "question_id long, pos long, url string")
    pages = spark.createDataFrame([(1, "http://a", "old", 200), (2, "http://a", "new", 200)],
                                  "page_id long, url string, html string, status int")
    fetched, _ = fetch_join(results, pages, broadcast_rows=0)
    assert [r.html for r in fetched.collect()] == ["new"]


def test_listing_blocks_in_order_with_missing_id(spark):
    body = '{"webPages":{"value":[{"name":"N1","url":"u1","snippet":"s1"},{"id":"7","name":"N2","url":"u2","snippet":"s2"}]}}'
    df = spark.createDataFrame([(3, 200, body)], SCHEMA)
    r = results_listing(scan_search_responses(df)).first()
    assert r.listing == "\nN1\nu1\ns1\n\n7\nN2\nu2\ns2\n\n"
    assert r.n_results == 2


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_a_page_is_made_once_for_all_its_results(spark, broadcast_rows):
    results = spark.createDataFrame([(q, 0, "u") for q in range(9)] + [(9, 1, "v"), (9, 2, "w"), (10, 0, "u")],
                                    "question_id long, pos long, url string")
    pages = spark.createDataFrame([(1, "u", "<p>old</p>", 200), (2, "u", "<p>new</p>", 200), (3, "v", "<b>v</b>", 200),
                                   (4, "w", "<p>a</p>", 200), (4, "w", "<p>b</p>", 200), (5, "x", "<p>x</p>", 200)],
                                  "page_id long, url string, html string, status int")
    made = []

    def of_page(rows):
        made.append(rows.count())
        return html_to_markdown(rows)

    fetched, failures = fetch_join(results, pages, broadcast_rows=broadcast_rows, of_page=of_page)
    assert sorted(made) == [1, 2]       # w is there twice, u and v once
    got = {(r.question_id, r.pos): (r.url, r.markdown) for r in fetched.collect()}
    want = {(q, 0): ("u", "source: u \nnew\n\n") for q in [*range(9), 10]}
    assert got == want | {(9, 1): ("v", "source: v \n**v**\n\n"), (9, 2): ("w", "source: w \nb\n\n")}
    assert fetched.count() == 12 and failures.count() == 0
