"""The answering flow as two plans around the model (ops 26 and 27).

prepare_answers: questions -> valid (5) -> memo lookup (9) -> misses only ->
search query (8) -> top-k pages (17) or given search responses (1) -> fetch
join (2) -> markdown (21) -> `page` requests (20).

finish_answers: page responses (7) -> ordered page answers (12) -> `final`
requests (20); final responses (7) -> answers -> memo (3).

The model runs between the two as a batch file exchange. What several outputs
need (looked-up questions, results, picked pages, judged responses) is written
once as a narrow table in the shared folder, so every input is scanned once;
`write_sinks` writes all outputs of a step in one job.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exchange import (KIND_FINAL, KIND_PAGE, build_final_requests, build_page_requests,
                                  collect_page_answers, judged_failures, judged_responses,
                                  queries_from_format_responses)
from ..operators.markdown import html_to_markdown
from ..operators.memo import memo_lookup, memo_merge
from ..operators.questions import normalize_query, valid_questions
from ..operators.retrieval import CorpusIndex, retrieve_topk
from ..functions.text import is_blank
from ..schemas import STAGE_QUESTION
from ..session import COMPRESSION, checkpointed, ensure_parallelism
from ..sources.pages import fetch_join
from ..sources.search import scan_search_responses, search_failures


@dataclass
class Prepared:
    hits: DataFrame           # (question_id, question, answer): served from the memo
    results: DataFrame        # (question_id, pos, url): ranked pages per new question
    page_requests: DataFrame  # (request_id, question_id, kind, pos, body)
    failures: DataFrame       # (question_id, stage, key, reason)


def _looked_up(questions: DataFrame, memo: DataFrame) -> DataFrame:
    """The questions with `_valid` and the stored `answer` (null: none),
    written once."""
    valid = valid_questions(questions)
    hits, misses = memo_lookup(valid, memo)
    invalid = questions.filter(is_blank(F.col("question")))
    rows = (hits.withColumn("_valid", F.lit(True))
            .unionByName(misses.withColumn("answer", F.lit(None).cast("string")).withColumn("_valid", F.lit(True)))
            .unionByName(invalid.withColumn("answer", F.lit(None).cast("string")).withColumn("_valid", F.lit(False))))
    return checkpointed(rows, "looked-up")


def prepare_answers(questions: DataFrame, memo: DataFrame, pages: DataFrame,
                    index: CorpusIndex | None = None, searches: DataFrame | None = None,
                    k: int = 5, mkt: str | None = None,
                    format_responses: DataFrame | None = None) -> Prepared:
    """Plan 26. `pages(page_id, url, html[, status])` is the crawl snapshot.

    Ranked pages come from `index` (an index over page ids, e.g. built from
    the markdown of the snapshot) or, when `searches` is given, from search
    API responses keyed by question_id. The search query is the rule-based
    rewrite, or the model's rewrite when `format_responses` is given (a
    failed rewrite falls back to the question and is recorded).
    """
    looked = _looked_up(questions, memo)
    hits = looked.filter("_valid AND answer IS NOT NULL").drop("_valid")
    misses = looked.filter("_valid AND answer IS NULL").drop("_valid", "answer")
    failures = looked.filter("NOT _valid").select(
        "question_id", F.lit(STAGE_QUESTION).alias("stage"), F.lit(None).cast("string").alias("key"),
        F.lit("blank").alias("reason"))
    if searches is not None:
        # every result that a response holds; `k` belongs to the index route
        asked = searches.join(misses.select("question_id"), "question_id", "left_semi")
        results = checkpointed(scan_search_responses(asked).select("question_id", "pos", "url"), "results")
        failures = failures.unionByName(search_failures(asked))
    else:
        if index is None:
            raise ValueError("need an index or search responses")
        if format_responses is not None:
            queries, fmt_fail = queries_from_format_responses(misses, format_responses)
            failures = failures.unionByName(fmt_fail)
        else:
            queries = normalize_query(misses)
        # market per question (`questions.mkt`), with `mkt` as the batch default
        if mkt is not None:
            own = F.col("mkt") if "mkt" in queries.columns else F.lit(None).cast("string")
            queries = queries.withColumn("mkt", F.coalesce(own, F.lit(mkt)))
        use_mkt = "mkt" in queries.columns and index.has_lang
        if mkt is not None and not index.has_lang:
            raise ValueError("a market filter needs an index that kept the document language")
        ranked = retrieve_topk(queries, index, k=k, qid_col="question_id", text_col="query",
                               mkt_col="mkt" if use_mkt else None)
        urls = pages.select(F.col("page_id").alias("doc_id"), "url")
        # k rows per question: small, read by the fetch join and its size check
        results = checkpointed(ranked.join(urls, "doc_id")
                               .select("question_id", (F.col("rank") - 1).alias("pos"), "url"))
    snapshot = pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))
    # a snapshot of few files is dealt out before markdown is made of it,
    # once per page, however many questions it answers
    pages_md, fetch_fail = fetch_join(results, ensure_parallelism(snapshot), of_page=html_to_markdown)
    requests = build_page_requests(pages_md, misses)
    return Prepared(hits, results, requests, failures.unionByName(fetch_fail))


@dataclass
class Finished:
    final_requests: DataFrame  # (request_id, question_id, kind, pos, body)
    answers: DataFrame         # (question_id, question, answer, n_pages)
    memo: DataFrame            # the store after the answers were merged in
    failures: DataFrame


def finish_answers(questions: DataFrame, page_responses: DataFrame,
                   final_responses: DataFrame | None, memo: DataFrame,
                   store_without_pages: bool = True) -> Finished:
    """Plan 27. Without `final_responses` only the final requests are made.

    Only valid questions that the memo does not answer take part, so a stored
    answer is neither asked for again nor replaced. A question whose pages all
    failed still gets a final request with an empty list; whether its answer
    is stored is `store_without_pages`. Of repeated final responses the
    largest content counts.
    """
    looked = _looked_up(questions, memo)
    qs = looked.filter("_valid AND answer IS NULL").select("question_id", "question")
    judged = judged_responses(page_responses)
    if final_responses is not None:
        judged = judged.unionByName(judged_responses(final_responses))
    judged = checkpointed(judged, "judged")
    good = judged.filter(F.col("reason").isNull())
    page_answers = collect_page_answers(good.filter(F.col("kind") == KIND_PAGE))
    final_requests = build_final_requests(qs, page_answers)
    failures = judged_failures(judged)
    if final_responses is None:
        answers = questions.sparkSession.createDataFrame(
            [], "question_id long, question string, answer string, n_pages long")
        return Finished(final_requests, answers, memo, failures)
    finals = good.filter(F.col("kind") == KIND_FINAL).groupBy("question_id").agg(F.max("content").alias("answer"))
    answers = (qs.join(finals, "question_id")
               .join(page_answers.select("question_id", "n_answers"), "question_id", "left")
               .select("question_id", "question", "answer",
                       F.coalesce("n_answers", F.lit(0)).cast("long").alias("n_pages")))
    to_store = answers if store_without_pages else answers.filter(F.col("n_pages") > 0)
    new_memo = memo_merge(memo, to_store.select("question", "answer"))
    return Finished(final_requests, answers, new_memo, failures)


# the columns of all outputs that are written together
SINK_SCHEMA = ("question_id long, question string, mkt string, answer string, n_pages long, pos long, url string, "
               "request_id string, kind string, body string, stage string, key string, reason string")


def write_sinks(step: "Prepared | Finished", path: str, sinks: tuple[str, ...] = ()) -> None:
    """Write the outputs of a step in one job: every row tagged with its sink,
    one write partitioned by it (`path/sink=hits`, ...). All outputs but the
    memo, or those named."""
    columns = [c.split() for c in SINK_SCHEMA.split(", ")]
    rows = None
    for f in fields(step):
        if f.name == "memo" or (sinks and f.name not in sinks):
            continue
        df = getattr(step, f.name)
        part = df.select(F.lit(f.name).alias("sink"), *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])
        rows = part if rows is None else rows.unionByName(part)
    rows.write.mode("errorifexists").partitionBy("sink").parquet(path, compression=COMPRESSION)


def read_sink(spark: SparkSession, path: str, sink: str, columns: list[str]) -> DataFrame:
    """One output of `write_sinks` (empty if it got no rows)."""
    return (spark.read.schema(SINK_SCHEMA + ", sink string").parquet(path)
            .filter(F.col("sink") == sink).select(*columns))


def refine_answers(queries: DataFrame, indexes: list[CorpusIndex], k: int = 5,
                   min_score: float = 1.0, qid_col: str = "qid",
                   text_col: str = "query") -> DataFrame:
    """Search, review, search again (the loop planned in SURVEY 2.11).

    `indexes` go from narrow to broad (e.g. the market's language, then the
    whole corpus). A query whose best page scores at least `min_score` is
    resolved in that round; the rest move to the next index. The last round
    keeps what it finds. The loop is bounded by `len(indexes)`. Each round's
    pending set is checkpointed, so lineage does not grow with the rounds.

    Returns (qid, rank, doc_id, score, round).
    """
    pending = queries.select(qid_col, text_col)
    accepted = None
    for rnd, index in enumerate(indexes):
        ranked = retrieve_topk(pending, index, k=k, qid_col=qid_col, text_col=text_col)
        last = rnd == len(indexes) - 1
        if last:
            keep = ranked
        else:
            good = (ranked.groupBy(qid_col).agg(F.max("score").alias("_best"))
                    .filter(F.col("_best") >= F.lit(min_score)).select(qid_col))
            keep = ranked.join(good, qid_col, "left_semi")
        keep = checkpointed(keep.withColumn("round", F.lit(rnd + 1).cast("long")))
        accepted = keep if accepted is None else accepted.unionByName(keep)
        if not last:
            pending = checkpointed(pending.join(keep.select(qid_col).distinct(), qid_col, "left_anti"))
    return accepted
