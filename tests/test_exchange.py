"""Model requests and responses (F4, F5, F12) and ordered page answers."""

import json

from pyspark.sql import functions as F

from askbatch.operators import exchange as X

RESP = "request_id string, status int, body string"


def test_f4_format_request_and_response(spark):
    qs = spark.createDataFrame([(1, "How do I make a cake?")], "question_id long, question string")
    req = X.build_format_requests(qs).first()
    body = json.loads(req.body)
    assert req.request_id == "format:1"
    assert body["model"] == X.MODEL and body["temperature"] == X.TEMPERATURE
    # one user message only (the reference's dict keeps the last role/content)
    assert [m["role"] for m in body["messages"]] == ["user"]
    assert "user's question: How do I make a cake?" in body["messages"][0]["content"]
    resp = spark.createDataFrame(
        [("format:1", 200, '{"choices":[{"message":{"content":"formatted question"}}]}')], RESP)
    assert X.parse_responses(resp).first().content == "formatted question"


def test_f5_final_request_holds_answers_in_order(spark):
    content = spark.createDataFrame([(5, 1, "response2"), (5, 0, "response1")],
                                    "question_id long, pos long, content string")
    answers = X.collect_page_answers(content)
    assert answers.first().answers == ["response1", "response2"]
    qs = spark.createDataFrame([(5, "test question"), (6, "no pages")], "question_id long, question string")
    reqs = {r.question_id: json.loads(r.body)["messages"][0]["content"]
            for r in X.build_final_requests(qs, answers).collect()}
    assert '["response1","response2"]' in reqs[5]
    assert "Here's their question: test question" in reqs[5]
    # a question without page answers still gets a final request, with []
    assert "Search results:\n\n        []\n" in reqs[6]
    resp = spark.createDataFrame([("final:5", 200, '{"choices":[{"message":{"content":"final answer"}}]}')], RESP)
    r = X.parse_responses(resp).first()
    assert (r.kind, r.question_id, r.pos, r.content) == ("final", 5, None, "final answer")


def test_f12_bad_responses_become_failures(spark):
    resp = spark.createDataFrame([("page:1:0", 500, None), ("page:1:1", 200, '{"choices":[]}'),
                                  ("page:1:2", 200, '{"choices":'), ("page:1:3", 200,
                                  '{"choices":[{"message":{"content":"ok"}}]}')], RESP)
    assert [r.content for r in X.parse_responses(resp).collect()] == ["ok"]
    fails = {r.key: r.reason for r in X.response_failures(resp).collect()}
    assert fails == {"page:1:0": "http_status", "page:1:1": "no_content", "page:1:2": "bad_json"}
    assert all(r.question_id == 1 for r in X.response_failures(resp).collect())


def test_page_request_uses_question_and_markdown(spark):
    md = spark.createDataFrame([(1, 0, "source: http://x \nbody\n\n")], "question_id long, pos long, markdown string")
    qs = spark.createDataFrame([(1, "q?")], "question_id long, question string")
    r = X.build_page_requests(md, qs).first()
    content = json.loads(r.body)["messages"][0]["content"]
    assert r.request_id == "page:1:0" and r.pos == 0
    assert "question: q?" in content and "source: http://x \nbody" in content


def test_q6_failed_rewrite_falls_back_to_question(spark):
    qs = spark.createDataFrame([(1, "raw one"), (2, "raw two"), (3, "raw three")], "question_id long, question string")
    resp = spark.createDataFrame([("format:1", 200, '{"choices":[{"message":{"content":"rewritten"}}]}'),
                                  ("format:2", 500, None)], RESP)
    got, fails = X.queries_from_format_responses(qs, resp)
    assert {r.question_id: r.query for r in got.collect()} == {1: "rewritten", 2: "raw two", 3: "raw three"}
    assert [(r.key, r.reason) for r in fails.collect()] == [("format:2", "http_status")]
