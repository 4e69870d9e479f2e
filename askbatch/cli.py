"""Command line for the whole flow around the model, one batch at a time.

    python -m askbatch.cli index   --corpus pages.parquet --out IDX [--mkt en-us]
    python -m askbatch.cli format  --questions Q --memo M --out OUT
    python -m askbatch.cli prepare --questions Q --pages P --memo M --out OUT
                                   (--index IDX | --searches S) [--format-responses F] [--mkt en-us]
    python -m askbatch.cli finish  --questions Q --responses R --memo M --out OUT
    python -m askbatch.cli refine  --questions Q --index NARROW --index BROAD --out OUT

`format` writes the query-rewrite requests of new questions. `prepare` writes
its outputs in one job, one folder each: `OUT/sink=hits` (answers served from
the memo), `OUT/sink=page_requests` (bodies for the model), `OUT/sink=results`
and `OUT/sink=failures`. The model's replies come back as
`responses(request_id, status, body)`. `finish` writes `sink=final_requests`,
`sink=answers` and `sink=failures` and stores the answers in the memo. `refine`
searches again, in the next index, for questions without a good page. All paths
are parquet folders on shared storage; questions may carry a market (`mkt`).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from askbatch.operators.exchange import build_format_requests
from askbatch.operators.markdown import html_to_markdown
from askbatch.operators.memo import MemoTable
from askbatch.operators.retrieval import CorpusIndex, build_index
from askbatch.operators.questions import normalize_query, valid_questions
from askbatch.plans.answering import finish_answers, prepare_answers, read_sink, refine_answers, write_sinks
from askbatch.session import ensure_checkpoint_dir


PAGE_LANG = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([a-z]{2})(?:/|$)"


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("askbatch").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def cmd_index(spark: SparkSession, a) -> None:
    pages = spark.read.parquet(a.corpus).select("page_id", "url", "html")
    # a page's language is the first path segment of its URL (`/en/...`)
    pages = pages.withColumn("lang", F.regexp_extract("url", PAGE_LANG, 1))
    md = html_to_markdown(pages)
    build_index(md, id_col="page_id", text_col="markdown", mkt=a.mkt,
                lang_col="lang").materialize(a.out)


def _questions(spark: SparkSession, path: str):
    q = spark.read.parquet(path)
    return q.select("question_id", "question", *[c for c in ("mkt",) if c in q.columns])


def cmd_format(spark: SparkSession, a) -> None:
    _, new = MemoTable(spark, a.memo).lookup(valid_questions(_questions(spark, a.questions)))
    build_format_requests(new).write.mode("errorifexists").parquet(f"{a.out}/requests")


def cmd_prepare(spark: SparkSession, a) -> None:
    questions = _questions(spark, a.questions)
    memo = MemoTable(spark, a.memo)
    stored = memo.read(memo.parts_of(questions))
    prep = prepare_answers(
        questions, stored, spark.read.parquet(a.pages), k=a.k, mkt=a.mkt,
        index=CorpusIndex.load(spark, a.index) if a.index else None,
        searches=spark.read.parquet(a.searches) if a.searches else None,
        format_responses=spark.read.parquet(a.format_responses) if a.format_responses else None)
    write_sinks(prep, a.out)


def cmd_finish(spark: SparkSession, a) -> None:
    questions = _questions(spark, a.questions)
    responses = spark.read.parquet(a.responses).select("request_id", "status", "body")
    page = responses.filter(F.col("request_id").startswith("page:"))
    final = responses.filter(F.col("request_id").startswith("final:"))
    memo = MemoTable(spark, a.memo)
    done = finish_answers(questions, page, final, memo.read(memo.parts_of(questions)))
    write_sinks(done, a.out)
    answers = read_sink(spark, a.out, "answers", ["question", "answer", "n_pages"])
    if a.skip_empty:
        answers = answers.filter("n_pages > 0")
    # a question asked twice in a batch keeps one of its answers
    memo.store(answers.groupBy("question").agg(F.max("answer").alias("answer")))


def cmd_refine(spark: SparkSession, a) -> None:
    queries = normalize_query(valid_questions(_questions(spark, a.questions)))
    found = refine_answers(queries, [CorpusIndex.load(spark, p) for p in a.index], k=a.k, min_score=a.min_score,
                           qid_col="question_id")
    found.write.mode("errorifexists").parquet(a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="askbatch")
    sub = p.add_subparsers(dest="cmd", required=True)
    i = sub.add_parser("index")
    i.add_argument("--corpus", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--mkt", default=None)
    g = sub.add_parser("format")
    for name in ("questions", "memo", "out"):
        g.add_argument(f"--{name}", required=True)
    r = sub.add_parser("prepare")
    for name in ("questions", "pages", "memo", "out"):
        r.add_argument(f"--{name}", required=True)
    route = r.add_mutually_exclusive_group(required=True)
    route.add_argument("--index")
    route.add_argument("--searches")
    r.add_argument("--format-responses", default=None)
    r.add_argument("--mkt", default=None, help="market of questions that have none of their own")
    r.add_argument("--k", type=int, default=5)
    f = sub.add_parser("finish")
    for name in ("questions", "responses", "memo", "out"):
        f.add_argument(f"--{name}", required=True)
    f.add_argument("--skip-empty", action="store_true",
                   help="do not store answers of questions without page answers")
    n = sub.add_parser("refine")
    n.add_argument("--questions", required=True)
    n.add_argument("--index", action="append", required=True, help="from narrow to broad")
    n.add_argument("--out", required=True)
    n.add_argument("--k", type=int, default=5)
    n.add_argument("--min-score", type=float, default=1.0)
    a = p.parse_args(argv)
    spark = spark or _spark()
    {"index": cmd_index, "format": cmd_format, "prepare": cmd_prepare, "finish": cmd_finish,
     "refine": cmd_refine}[a.cmd](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
