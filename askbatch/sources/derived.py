"""Input tables derived from the corpus tables for tests and the bench.

The engine takes search responses, page snapshots and model responses as
tables. The corpus provides none of them directly, so these builders derive
them, deterministically, from `pages` and `conversations`. Every source row
stays whole; failures are further rows with identifiers of their own (`twin`),
made from some of the real rows, so that no operator loses input to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_query, strip_edges

# Id layout and failure assignment for derived fixtures.
RESULTS_PER_SEARCH = 5
TURN_BASE = 1000          # question_id = conv_id * TURN_BASE + turn
SEARCH_CASES = 8          # question_id % 8: 4 -> 503, 5 -> broken JSON, 6 -> {}, 7 -> no value
PAGE_CASES = 9            # (turn + pos) % 9: 4 -> 500, 7 -> no choices, 8 -> broken JSON
FINAL_CASES = 5           # turn % 5: 3 -> 500 (final), 1 -> 502 (format)
FETCH_CASES = 7           # page_id % 7: 2 -> 404, 5 -> never downloaded
GONE, MISSING = "?gone", "?missing"     # URL endings of those two
BROKEN_JSON_LEAD = "{"    # a stray brace before a whole body makes it invalid JSON


def broken_json(body: Column) -> Column:
    return F.concat(F.lit(BROKEN_JSON_LEAD), body)


def question_id(conv_id: Column, turn: Column) -> Column:
    return (conv_id * F.lit(TURN_BASE) + turn).cast("long")


def twin(key: Column) -> Column:
    """Identifier of a failure row made from the row `key`: always negative."""
    return F.lit(-1) - key


def failing_questions(questions: DataFrame) -> DataFrame:
    """The questions again under the identifiers of their failure rows."""
    return questions.withColumn("question_id", twin(F.col("question_id")))


def questions_from_conversations(conv: DataFrame) -> DataFrame:
    """questions(question_id, question, mkt): every `user` turn."""
    return (conv.filter(F.col("role") == "user")
            .select(question_id(F.col("conv_id"), F.col("turn")).alias("question_id"),
                    F.col("text").alias("question"),
                    F.lit(None).cast("string").alias("mkt")))


def qa_pairs(conv: DataFrame) -> DataFrame:
    """(question_id, question, answer): a `user` turn and the `assistant`
    turn right after it in the same conversation."""
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return (u.join(a, ["conv_id", "turn"])
            .select(question_id(F.col("conv_id"), F.col("turn")).alias("question_id"),
                    "question", "answer"))


def search_envelopes(pages: DataFrame) -> DataFrame:
    """searches(question_id, status, body): consecutive page ids, five per
    question, as a search API response; failing responses beside them."""
    item = F.struct(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("name"),
        F.col("url").alias("url"),
        strip_edges(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("snippet"),
    )
    grouped = (pages.select((F.col("page_id") / RESULTS_PER_SEARCH).cast("long").alias("question_id"),
                            F.struct(F.col("page_id").alias("k"), item.alias("v")).alias("e"))
               .groupBy("question_id")
               .agg(F.array_sort(F.collect_list("e")).alias("es")))
    body = F.to_json(F.struct(F.struct(F.transform("es", lambda e: e["v"]).alias("value"))
                              .alias("webPages")))
    case = F.pmod(F.col("question_id"), F.lit(SEARCH_CASES))
    responses = grouped.select("question_id", F.lit(200).alias("status"), body.alias("body"))
    failing = responses.withColumn("_c", case).filter("_c >= 4").select(
        twin(F.col("question_id")).alias("question_id"),
        F.when(F.col("_c") == 4, F.lit(503)).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("_c") == 5, broken_json(F.col("body"))).when(F.col("_c") == 6, F.lit("{}"))
         .when(F.col("_c") == 7, F.lit('{"webPages":{}}')).alias("body"))
    return responses.unionByName(failing)


def failing_snapshot(pages: DataFrame) -> DataFrame:
    """Snapshot rows of pages that the server no longer had."""
    return (pages.filter(F.pmod("page_id", F.lit(FETCH_CASES)) == 2)
            .select(twin(F.col("page_id")).alias("page_id"), F.concat("url", F.lit(GONE)).alias("url"),
                    F.lit("<p>gone</p>").alias("html"), F.lit(404).alias("status")))


def failing_results(pages: DataFrame) -> DataFrame:
    """Search results whose page answers 404 or was never downloaded."""
    case = F.pmod("page_id", F.lit(FETCH_CASES))
    return (pages.filter(case.isin(2, 5))
            .select(twin(F.col("page_id")).alias("question_id"), F.lit(0).cast("long").alias("pos"),
                    F.concat("url", F.when(case == 2, F.lit(GONE)).otherwise(F.lit(MISSING))).alias("url")))


def chat_body(content: Column) -> Column:
    """`{"choices":[{"message":{"content": ...}}]}`"""
    return F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message")))
                              .alias("choices")))


def page_response_envelopes(conv: DataFrame) -> DataFrame:
    """responses(request_id, status, body) for `page` requests: each line of
    the assistant reply to a question is one page answer, `pos` = line."""
    qa = qa_pairs(conv).select("question_id", F.posexplode(F.split("answer", "\n")).alias("pos", "line"))
    case = F.pmod(F.col("question_id") % TURN_BASE + F.col("pos"), F.lit(PAGE_CASES))

    def rid(key: Column) -> Column:
        return F.concat_ws(":", F.lit("page"), key.cast("string"), F.col("pos").cast("string")).alias("request_id")

    body = chat_body(F.col("line"))
    good = qa.select(rid(F.col("question_id")), F.lit(200).alias("status"), body.alias("body"))
    failing = qa.withColumn("_c", case).filter(F.col("_c").isin(4, 7, 8)).select(
        rid(twin(F.col("question_id"))),
        F.when(F.col("_c") == 4, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("_c") == 7, F.lit('{"choices":[]}')).when(F.col("_c") == 8, broken_json(body)).alias("body"))
    return good.unionByName(failing)


def _replies(qa: DataFrame, kind: str, content: Column, failing_case: int, failing_status: int) -> DataFrame:
    """One good response per question, and failing ones for some."""
    case = F.pmod(F.col("question_id") % TURN_BASE, F.lit(FINAL_CASES))

    def rid(key: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), key.cast("string")).alias("request_id")

    good = qa.select(rid(F.col("question_id")), F.lit(200).alias("status"), chat_body(content).alias("body"))
    failing = qa.filter(case == failing_case).select(
        rid(twin(F.col("question_id"))), F.lit(failing_status).alias("status"), F.lit(None).cast("string").alias("body"))
    return good.unionByName(failing)


def final_response_envelopes(conv: DataFrame) -> DataFrame:
    """responses(request_id, status, body) for `final` requests: the whole
    assistant reply is the final answer."""
    return _replies(qa_pairs(conv), "final", F.col("answer"), 3, 500)


def doc_pages_from_conversations(conv: DataFrame) -> DataFrame:
    """doc_pages(doc_id, page_no, text): a conversation as a paged document."""
    return conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def format_response_envelopes(conv: DataFrame) -> DataFrame:
    """responses(request_id, status, body) for `format` requests: the
    rule-based rewrite of the whole question stands in for the model's."""
    return _replies(qa_pairs(conv), "format", normalize_query(F.col("question")), 1, 502)
