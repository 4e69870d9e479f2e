"""The command line runs index -> prepare -> (model) -> finish on files."""

from pyspark.sql import functions as F

from askbatch.cli import main
from askbatch.operators.memo import MemoTable
from askbatch.plans import catalog as C
from askbatch.session import scratch_path
from askbatch.sources import derived

SF = "/root/testdata/sf0.001"


def test_cli_round_trip(spark):
    d = scratch_path(spark, "cli")
    qs = C._questions(spark, SF).withColumn("mkt", F.when(F.col("question_id") % 2 == 0, "en-us"))
    qs.write.parquet(f"{d}/questions")
    memo, pages = f"{d}/memo", f"{SF}/pages.parquet"
    n_questions = qs.count()
    main(["index", "--corpus", pages, "--out", f"{d}/index"], spark)
    main(["format", "--questions", f"{d}/questions", "--memo", memo, "--out", f"{d}/fmt"], spark)
    requests = spark.read.parquet(f"{d}/fmt/requests")
    assert requests.count() == n_questions and requests.filter("kind <> 'format'").count() == 0
    # the model's side: rewrites of the questions, then answers
    conv = C._conv(spark, SF)
    derived.format_response_envelopes(conv).write.parquet(f"{d}/rewrites")
    common = ["prepare", "--questions", f"{d}/questions", "--pages", pages, "--index", f"{d}/index", "--memo", memo]
    main([*common, "--format-responses", f"{d}/rewrites", "--out", f"{d}/prep"], spark)
    reqs = spark.read.parquet(f"{d}/prep").filter("sink = 'page_requests'")
    assert reqs.count() > 0 and spark.read.parquet(f"{d}/prep").filter("sink = 'hits'").count() == 0
    # questions with a market got pages of its language only
    english = spark.read.parquet(pages).filter(F.col("url").rlike("://[^/]+/en(/|$)")).select("url")
    got = spark.read.parquet(f"{d}/prep").filter("sink = 'results' AND question_id % 2 = 0")
    assert got.count() > 0 and got.join(english, "url", "left_anti").count() == 0
    responses = derived.page_response_envelopes(conv).unionByName(derived.final_response_envelopes(conv))
    responses.write.parquet(f"{d}/responses")
    main(["finish", "--questions", f"{d}/questions", "--responses", f"{d}/responses",
          "--memo", memo, "--out", f"{d}/done"], spark)
    n_answers = spark.read.parquet(f"{d}/done").filter("sink = 'answers'").count()
    assert n_answers > 0 and MemoTable(spark, memo).size() == n_answers
    # a second round serves those questions from the memo and asks for no rewrite
    main([*common, "--out", f"{d}/prep2"], spark)
    assert spark.read.parquet(f"{d}/prep2").filter("sink = 'hits'").count() == n_answers
    main(["format", "--questions", f"{d}/questions", "--memo", memo, "--out", f"{d}/fmt2"], spark)
    assert spark.read.parquet(f"{d}/fmt2/requests").count() == n_questions - n_answers


def test_cli_searches_and_refine(spark):
    d = scratch_path(spark, "cli-search")
    pages = f"{SF}/pages.parquet"
    searches = derived.search_envelopes(C._pages(spark, SF))
    searches.write.parquet(f"{d}/searches")
    searches.select("question_id", F.concat(F.lit("question "), "question_id").alias("question")).write.parquet(f"{d}/questions")
    main(["prepare", "--questions", f"{d}/questions", "--pages", pages, "--searches", f"{d}/searches",
          "--memo", f"{d}/memo", "--out", f"{d}/prep"], spark)
    out = spark.read.parquet(f"{d}/prep")
    assert out.filter("sink = 'page_requests'").count() == spark.read.parquet(pages).count()
    assert out.filter("sink = 'failures' AND stage = 'search'").count() == searches.filter("question_id < 0").count()
    C._questions(spark, SF).write.parquet(f"{d}/asked")
    main(["index", "--corpus", pages, "--out", f"{d}/fr", "--mkt", "fr-fr"], spark)
    main(["index", "--corpus", pages, "--out", f"{d}/all"], spark)
    main(["refine", "--questions", f"{d}/asked", "--index", f"{d}/fr", "--index", f"{d}/all", "--out", f"{d}/found",
          "--min-score", "2"], spark)
    rounds = {r["round"] for r in spark.read.parquet(f"{d}/found").select("round").distinct().collect()}
    assert rounds == {1, 2}


def test_cli_index_by_market(spark):
    d = scratch_path(spark, "cli-mkt")
    main(["index", "--corpus", f"{SF}/pages.parquet", "--out", f"{d}/index", "--mkt", "fr-fr"], spark)
    n = spark.read.parquet(f"{d}/index/docs").count()
    want = spark.read.parquet(f"{SF}/pages.parquet").filter(F.col("url").rlike("://[^/]+/fr(/|$)")).count()
    assert n == want > 0
