"""Model exchange as tables: build request bodies (op 20), parse responses
(op 7) and gather page answers in order (op 12).

The model runs outside the engine: `requests(request_id, question_id, kind,
pos, body)` goes out as a table and `responses(request_id, status, body)`
comes back as one. Request ids are `format:{qid}`, `page:{qid}:{pos}` and
`final:{qid}`, so responses join back without a lookup table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STAGE_MODEL
from ..session import fits_broadcast

# Request settings and prompt texts of the answering flow.
MODEL = "gpt-4o-mini"
TEMPERATURE = 0.2
ROLE = "user"
FORMAT_PROMPT = """
        You are helping a user search the internet and answer a question. Here's the question from the user. Based on the question, can you reformat the question into a good query for a search engine? For example, if the user's question is "I am having trouble with my computer overheating. What should I do?" you could reformat it as "How to prevent computer overheating". Respond only with the reformatted question. Do not use the site keyword in the query:

        user's question: {question}
        """
PAGE_PROMPT = """
        You are helping a user search the internet and answer a question. Here's the raw page formatted in markdown. Based on this data, generate a summary of why this question relates to the user's question. If it answers the user's question, provide the answer:

        question: {question}

        page content:
        {page}
        """
FINAL_PROMPT = """
        You are helping a user search the internet and answer a question. Here are the results of their internet search. Only answer the questions based on the search results. Mention the website if the answer came from a website. Format the answer in markdown:

        Search results:

        {answers}

        Based on the search results, what is the answer to the user's question?
        Here's their question: {question}
        """

KIND_FORMAT, KIND_PAGE, KIND_FINAL = "format", "page", "final"
# Response failure reasons.
REASON_HTTP = "http_status"
REASON_BAD_JSON = "bad_json"
REASON_NO_CONTENT = "no_content"

_SLOT = re.compile(r"\{(\w+)\}")


def fill(template: str, **slots: Column) -> Column:
    """Template with `{name}` slots -> concat of literal pieces and columns."""
    parts, last = [], 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[last:m.start()]))
        parts.append(slots[m.group(1)])
        last = m.end()
    parts.append(F.lit(template[last:]))
    return F.concat(*parts)


def request_body(prompt: Column, model: str = MODEL, temperature: float = TEMPERATURE) -> Column:
    """`{"messages":[{"role":"user","content":...}],"model":...,"temperature":...}`."""
    msg = F.struct(F.lit(ROLE).alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(F.array(msg).alias("messages"), F.lit(model).alias("model"),
                              F.lit(float(temperature)).alias("temperature")))


def request_id(kind: str, qid: Column, pos: Column | None = None) -> Column:
    parts = [F.lit(kind), qid.cast("string")] + ([pos.cast("string")] if pos is not None else [])
    return F.concat_ws(":", *parts)


def _requests(df: DataFrame, kind: str, prompt: Column, pos: Column | None,
              model: str, temperature: float) -> DataFrame:
    return df.select(
        request_id(kind, F.col("question_id"), pos).alias("request_id"),
        F.col("question_id").cast("long").alias("question_id"),
        F.lit(kind).alias("kind"),
        (pos.cast("long") if pos is not None else F.lit(None).cast("long")).alias("pos"),
        request_body(prompt, model, temperature).alias("body"))


def build_format_requests(questions: DataFrame, model: str = MODEL,
                          temperature: float = TEMPERATURE) -> DataFrame:
    """One query-rewrite request per question (narrow)."""
    return _requests(questions, KIND_FORMAT, fill(FORMAT_PROMPT, question=F.col("question")),
                     None, model, temperature)


DEFAULT_BROADCAST_ROWS = 2_000_000


def build_page_requests(pages_md: DataFrame, questions: DataFrame, model: str = MODEL,
                        temperature: float = TEMPERATURE,
                        broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """One request per (question, page): `pages_md(question_id, pos, markdown)`.

    The question batch is broadcast when it fits the broadcast limits (rows
    and bytes), so the page text is not shuffled for this join."""
    qs = questions.select("question_id", "question")
    if fits_broadcast(qs, broadcast_rows):
        qs = F.broadcast(qs)
    joined = pages_md.join(qs, "question_id")
    prompt = fill(PAGE_PROMPT, question=F.col("question"), page=F.col("markdown"))
    return _requests(joined, KIND_PAGE, prompt, F.col("pos"), model, temperature)


def build_final_requests(questions: DataFrame, page_answers: DataFrame, model: str = MODEL,
                         temperature: float = TEMPERATURE) -> DataFrame:
    """One request per question with its ordered page answers embedded as a
    JSON array; a question without answers still gets one (empty list)."""
    joined = (questions.select("question_id", "question")
              .join(page_answers.select("question_id", "answers"), "question_id", "left")
              .withColumn("answers", F.coalesce("answers", F.array().cast("array<string>"))))
    prompt = fill(FINAL_PROMPT, question=F.col("question"), answers=F.to_json(F.col("answers")))
    return _requests(joined, KIND_FINAL, prompt, None, model, temperature)


def _parsed(responses: DataFrame) -> DataFrame:
    parts = F.split(F.col("request_id"), ":")
    return responses.select(
        "request_id", "status",
        F.get(parts, 0).alias("kind"),
        F.get(parts, 1).try_cast("long").alias("question_id"),
        F.get(parts, 2).try_cast("long").alias("pos"),
        F.try_parse_json("body").alias("_v")) \
        .withColumn("_content", F.try_variant_get("_v", "$.choices[0].message.content", "string"))


def _content() -> Column:
    return F.col("_content")


def _reason() -> Column:
    return (F.when(F.col("status").isNull() | (F.col("status") != 200), F.lit(REASON_HTTP))
             .when(F.col("_v").isNull(), F.lit(REASON_BAD_JSON))
             .when(_content().isNull(), F.lit(REASON_NO_CONTENT)))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(request_id, kind, question_id, pos, content) for good responses:
    status 200 and `choices[0].message.content` present (narrow)."""
    return (_parsed(responses).filter(_reason().isNull())
            .select("request_id", "kind", "question_id", "pos", _content().alias("content")))


def response_failures(responses: DataFrame) -> DataFrame:
    """failures(question_id, stage, key, reason) for the other responses."""
    return (_parsed(responses).withColumn("reason", _reason())
            .filter(F.col("reason").isNotNull())
            .select("question_id", F.lit(STAGE_MODEL).alias("stage"),
                    F.col("request_id").alias("key"), "reason"))


def judged_responses(responses: DataFrame) -> DataFrame:
    """(request_id, kind, question_id, pos, content, reason): both kinds of
    row at once, `reason` null where the response is good (narrow)."""
    return _parsed(responses).select("request_id", "kind", "question_id", "pos",
                                     F.when(_reason().isNull(), _content()).alias("content"), _reason().alias("reason"))


def judged_failures(judged: DataFrame) -> DataFrame:
    """failures(question_id, stage, key, reason) of judged responses."""
    return judged.filter(F.col("reason").isNotNull()).select(
        "question_id", F.lit(STAGE_MODEL).alias("stage"), F.col("request_id").alias("key"), "reason")


def collect_page_answers(content: DataFrame) -> DataFrame:
    """(question_id, answers array<string>, n_answers), answers by `pos`.

    One group per question; its size is the number of distinct positions,
    which retrieval bounds by k. Repeated (question, pos) rows, e.g. a
    response delivered twice, are reduced map-side first (greatest content
    wins), so a hot question cannot pile rows into one task.
    """
    one = content.groupBy("question_id", "pos").agg(F.max("content").alias("content"))
    return (one.groupBy("question_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("_a"))
            .select("question_id", F.transform("_a", lambda x: x["content"]).alias("answers"),
                    F.size("_a").cast("long").alias("n_answers")))


def queries_from_format_responses(questions: DataFrame, responses: DataFrame,
                                  out: str = "query") -> tuple[DataFrame, DataFrame]:
    """Search queries from the model's rewrite (`format` responses).

    A question whose rewrite failed or is missing keeps its raw text as the
    query, and the failure is returned as a row (the query is never the
    response itself). Returns (questions + `out`, failures).
    """
    fmt = responses.filter(F.col("request_id").startswith(KIND_FORMAT + ":"))
    good = (parse_responses(fmt).filter(F.col("kind") == KIND_FORMAT)
            .groupBy("question_id").agg(F.max("content").alias("_rewrite")))
    with_query = (questions.join(good, "question_id", "left")
                  .withColumn(out, F.coalesce(F.col("_rewrite"), F.col("question")))
                  .drop("_rewrite"))
    return with_query, response_failures(fmt)
