"""Plans 26 and 27 end to end on the sf0.001 tables, with invariants."""

from pyspark.sql import functions as F

from askbatch.operators.memo import memo_lookup
from askbatch.operators.questions import valid_questions
from askbatch.plans import catalog as C
from askbatch.schemas import MEMO
from askbatch.plans.answering import finish_answers, prepare_answers, read_sink, write_sinks
from askbatch.session import scratch_path
from askbatch.sources import derived
from askbatch.sources.pages import snapshot_from_pages

SF = "/root/testdata/sf0.001"


def test_prepare_with_index_invariants(spark):
    qs = C._questions(spark, SF)
    memo = C._memo(spark, SF)
    pages = snapshot_from_pages(C._pages(spark, SF))
    prep = prepare_answers(qs, memo, pages, index=C._page_index(spark, SF), k=5)
    valid = valid_questions(qs)
    hits, misses = memo_lookup(valid, memo)
    # hits + misses = valid questions; hits are what the plan serves
    assert hits.count() + misses.count() == valid.count()
    assert prep.hits.count() == hits.count()
    # at most k pages per new question; results = fetched + fetch failures
    per_q = prep.results.groupBy("question_id").count().agg(F.max("count")).first()[0]
    assert per_q <= 5
    fetch_fail = prep.failures.filter(F.col("stage") == "fetch").count()
    assert prep.page_requests.count() + fetch_fail == prep.results.count()
    # only new questions are searched
    assert prep.results.join(hits, "question_id", "left_semi").count() == 0


def test_prepare_with_search_responses(spark):
    pages = C._pages(spark, SF)
    searches = derived.search_envelopes(pages)
    qs = searches.select("question_id", F.concat(F.lit("question "), F.col("question_id").cast("string"))
                         .alias("question"))
    empty_memo = spark.createDataFrame([], MEMO)
    prep = prepare_answers(qs, empty_memo, snapshot_from_pages(pages), searches=searches, k=5)
    n_ok = searches.filter("question_id >= 0").count()
    assert prep.results.select("question_id").distinct().count() == n_ok
    assert prep.failures.filter(F.col("stage") == "search").count() == searches.count() - n_ok
    assert prep.page_requests.count() > 0


def test_finish_answers_and_memo(spark):
    conv = C._conv(spark, SF)
    qs = C._questions(spark, SF)
    empty_memo = spark.createDataFrame([], MEMO)
    pr, fr = derived.page_response_envelopes(conv), derived.final_response_envelopes(conv)
    done = finish_answers(qs, pr, fr, empty_memo)
    # every valid new question gets a final request, with or without page answers
    assert done.final_requests.count() == qs.count()
    # a stored answer is neither asked for again nor replaced
    stored = done.answers.select("question", F.lit("good").alias("answer"),
                                 F.current_timestamp().alias("stored_at")).limit(3)
    stored = spark.createDataFrame(stored.collect(), MEMO)
    again = finish_answers(qs, pr, fr.unionByName(fr), stored)
    known = [r.question for r in stored.collect()]
    assert again.answers.filter(F.col("question").isin(known)).count() == 0
    assert again.memo.filter(F.col("answer") == "good").count() == len(set(known))
    assert again.answers.groupBy("question_id").count().filter("count > 1").count() == 0
    ok_finals = fr.filter(F.col("status") == 200).count()
    assert done.answers.count() == ok_finals
    assert done.memo.count() == done.answers.select("question").distinct().count()
    strict = finish_answers(qs, pr, fr, empty_memo, store_without_pages=False)
    assert strict.memo.count() == done.answers.filter("n_pages > 0").count()
    # only requests go out without final responses
    part = finish_answers(qs, pr, None, empty_memo)
    assert part.final_requests.count() == qs.count() and part.answers.count() == 0


def test_prepare_with_model_rewrites(spark):
    conv = C._conv(spark, SF)
    qs = C._questions(spark, SF)
    empty_memo = spark.createDataFrame([], MEMO)
    fmt = derived.format_response_envelopes(conv)
    prep = prepare_answers(qs.unionByName(derived.failing_questions(qs)), empty_memo,
                           snapshot_from_pages(C._pages(spark, SF)),
                           index=C._page_index(spark, SF), format_responses=fmt)
    n_fmt_fail = fmt.filter(F.col("status") != 200).count()
    assert prep.failures.filter(F.col("stage") == "model").count() == n_fmt_fail
    assert prep.results.count() > 0


def test_all_outputs_in_one_job(spark):
    """One write gives every output, and the inputs were read once each."""
    from askbatch.operators.stats import counted
    qs, memo = C._questions(spark, SF).select("question_id", "question"), C._memo_table(spark, SF).read()
    pages = snapshot_from_pages(C._pages(spark, SF))
    qs, n_qs = counted(qs, "questions")
    prep = prepare_answers(qs, memo, pages, index=C._page_index(spark, SF), k=5)
    prep.page_requests, n_req = counted(prep.page_requests, "requests")
    path = scratch_path(spark, "sinks")
    write_sinks(prep, path)
    # counts taken while the flow's own jobs ran
    assert n_qs.get["rows"] == C._questions(spark, SF).count()
    rows = spark.read.parquet(path).groupBy("sink").count().collect()
    by = {r.sink: r["count"] for r in rows}
    assert by["hits"] == prep.hits.count() and by["results"] == prep.results.count()
    assert by["page_requests"] == n_req.get["rows"] > 0
    got = read_sink(spark, path, "hits", ["question_id", "answer"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, prep.hits.select("question_id", "answer").collect()))
    assert read_sink(spark, path, "failures", ["question_id", "reason"]).count() == prep.failures.count()


def test_failed_question_and_status_rows(spark):
    qs = spark.createDataFrame([(1, "known"), (2, " "), (3, None), (4, "new")], "question_id long, question string")
    memo = spark.createDataFrame([("known", "kept"), ("known", "kept")], "question string, answer string") \
        .withColumn("stored_at", F.timestamp_seconds(F.lit(1)))
    searches = spark.createDataFrame([(4, 500, None), (1, 200, "{}")], "question_id long, status int, body string")
    pages = spark.createDataFrame([(1, "http://a", "x")], "page_id long, url string, html string")
    prep = prepare_answers(qs, memo, pages, searches=searches)
    assert [(r.question_id, r.answer) for r in prep.hits.collect()] == [(1, "kept")]
    assert sorted((r.question_id, r.stage, r.reason) for r in prep.failures.collect()) == [
        (2, "question", "blank"), (3, "question", "blank"), (4, "search", "http_status")]
