"""Edge inputs: nulls, empties and odd JSON shapes do not raise (ANSI on)."""

from askbatch.operators import exchange as X
from askbatch.operators.retrieval import retrieve_topk
from askbatch.sources.search import scan_search_responses, search_failures


def test_retrieval_with_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "cat")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "cat"), (2, None), (3, "")], "qid long, query string")
    got = [(r.qid, r.doc_id) for r in retrieve_topk(qs, docs, k=5).collect()]
    assert got == [(1, 3)]


def test_retrieval_on_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "cat")], "qid long, query string")
    assert retrieve_topk(qs, docs, k=5).count() == 0


def test_odd_search_json_shapes(spark):
    rows = [(1, 200, "[1]"), (2, 200, '{"webPages":{"value":"x"}}'), (3, 200, '{"webPages":null}'),
            (4, 200, "null"), (5, None, "{}")]
    df = spark.createDataFrame(rows, "question_id long, status int, body string")
    assert scan_search_responses(df).count() == 0
    reasons = {r.question_id: r.reason for r in search_failures(df).collect()}
    assert reasons == {1: "no_webPages", 2: "no_value", 3: "no_value", 4: "empty_response", 5: "http_status"}


def test_odd_response_json_shapes(spark):
    rows = [("page:1:0", 200, '{"choices":[{"message":{}}]}'), ("page:1:1", 200, '{"choices":{"a":1}}'),
            ("weird", 200, '{"choices":[{"message":{"content":"ok"}}]}')]
    df = spark.createDataFrame(rows, "request_id string, status int, body string")
    ok = X.parse_responses(df).collect()
    assert [(r.request_id, r.kind, r.question_id, r.content) for r in ok] == [("weird", "weird", None, "ok")]
    assert sorted(r.reason for r in X.response_failures(df).collect()) == ["no_content", "no_content"]
