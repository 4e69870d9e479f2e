"""Registered queries: one per inventory operator, each over whole tables.

Every callable takes (spark, root) where root holds the corpus parquet
tables, and returns a lazy DataFrame whose columns match the DuckDB oracle
in `oracle.py` by name. Inputs the corpus lacks (search responses, model
responses, a memo) are derived from it by `sources.derived`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, exchange, links, listing, memo, questions, retrieval, stats
from ..operators.markdown import html_to_markdown
from ..schemas import MEMO
from ..sources import derived
from ..sources.pages import fetch_failures, fetch_join, fetched_picks, pick_pages, snapshot_from_pages
from ..sources.search import scan_search_responses, search_failures
from ..sources.tables import read_table
from ..session import checkpointed, ensure_checkpoint_dir, ensure_parallelism, fits_broadcast, scratch_path
from .answering import finish_answers, prepare_answers, read_sink, refine_answers, write_sinks

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values for derived fixtures.
MEMO_OLD_EPOCH = 1704067200      # 2024-01-01T00:00:00Z, + question_id seconds
MEMO_NEW_EPOCH = 1717200000      # a later batch
MEMO_DRAFT = "draft: "           # the earlier stored answer is marked as a draft
MEMO_EMPTIED = 7                 # question_id % 7 = 3: emptied later
MEMO_PARTITIONS = 16
BLANK_QUESTIONS = [(-1, None), (-2, ""), (-3, "   "), (-4, "\t"), (-5, " \n ")]
SITE_QUESTIONS = [(-11, "best cake recipe site:example.com"), (-12, "site:a.org"),
                  (-13, "How do I make a cake?")]
URL_CASES = [(b, h) for b in ("http://example.com", "http://e.com/a/b/c?x=1#f", "https://e.com/a/")
             for h in ("t.pdf", "/t.pdf", "../t.pdf", "../../../t.pdf", "./x/./t.pdf",
                       "//o.com/t.pdf", "https://z.org/q.pdf", "?p=t.pdf", "#t.pdf",
                       "x/../y.pdf", "a/..")]
PDF_REWRITE = (r'href="(/d[^"]*)"', 'href="$1.PDF"')


def _t(spark: SparkSession, root: str, name: str, cols: list[str] | None = None) -> DataFrame:
    return read_table(spark, root, name, cols)


def _heavy(df: DataFrame) -> DataFrame:
    """Split a text table across all cores when its files arrive as few
    splits, before CPU-heavy per-row work (markdown, links, tokenising).
    Scans that only feed a join or a hash probe are left as they are."""
    return ensure_parallelism(df)


def _conv(spark, root):
    return _t(spark, root, "conversations", ["conv_id", "turn", "role", "text"])


def _pages(spark, root):
    return _t(spark, root, "pages", ["page_id", "url", "html"])


def _questions(spark, root):
    return derived.questions_from_conversations(_conv(spark, root))


def _searches(spark, root):
    return derived.search_envelopes(_pages(spark, root))


def _results(spark, root):
    return scan_search_responses(_searches(spark, root))


def _asked_results(spark, root):
    """All results of the search responses, and some whose fetch fails."""
    return (_results(spark, root).select("question_id", "pos", "url")
            .unionByName(derived.failing_results(_pages(spark, root))))


def _snapshot(spark, root):
    pages = _pages(spark, root)
    return snapshot_from_pages(pages).unionByName(derived.failing_snapshot(pages))


def _twice_asked(spark, root):
    """Every question, and once more under the identifier of its failure rows."""
    qs = _questions(spark, root)
    return qs.unionByName(derived.failing_questions(qs))


def _prepared(spark, root, by_search=False):
    """The first step over all questions, with blank ones beside them; pages
    come from the index, or from the search responses of the questions."""
    qs = _questions(spark, root).select("question_id", "question")
    if by_search:
        searches = _searches(spark, root)
        asked = searches.select("question_id", F.concat(F.lit("question "), F.col("question_id").cast("string")).alias("question"))
        return prepare_answers(asked, _memo_of_searches(asked), _snapshot(spark, root), searches=searches)
    blanks = spark.createDataFrame(BLANK_QUESTIONS, "question_id long, question string")
    return prepare_answers(qs.unionByName(blanks), _memo_table(spark, root).read(), _snapshot(spark, root),
                           index=_page_index(spark, root), k=5)


def _memo_of_searches(asked):
    """A memo that answers every fourth of the questions, some with nothing."""
    return (asked.filter(F.pmod("question_id", F.lit(4)) == 1)
            .select("question", F.when(F.pmod("question_id", F.lit(8)) == 5, F.lit("")).otherwise(F.lit("stored")).alias("answer"),
                    F.timestamp_seconds(F.lit(MEMO_OLD_EPOCH)).alias("stored_at")))


def _finished(spark, root):
    """The second step on a filled memo, final responses given twice."""
    conv = _conv(spark, root)
    finals = derived.final_response_envelopes(conv)
    return finish_answers(_twice_asked(spark, root).select("question_id", "question"),
                          derived.page_response_envelopes(conv), finals.unionByName(finals),
                          _memo_table(spark, root).read())


def _fetch(spark, root):
    return fetch_join(_asked_results(spark, root), _snapshot(spark, root))


def _memo(spark, root):
    """Rows of a store over time: every key repeated (a draft, then the
    answer), and some emptied later."""
    qa = derived.qa_pairs(_conv(spark, root))

    def at(answer, seconds):
        return qa.select("question", answer.alias("answer"), F.timestamp_seconds(
            F.lit(MEMO_OLD_EPOCH + seconds) + F.col("question_id")).alias("stored_at"), "question_id")

    rows = (at(F.concat(F.lit(MEMO_DRAFT), F.col("answer")), 0).unionByName(at(F.col("answer"), 1))
            .unionByName(at(F.lit(""), 2).filter(F.col("question_id") % MEMO_EMPTIED == 3)))
    return rows.drop("question_id")


def _new_memo(spark, rows):
    """A store made from the rows."""
    table = memo.MemoTable(spark, scratch_path(spark, "memo"), partitions=MEMO_PARTITIONS)
    table.store(rows)
    return table


def _memo_table(spark, root):
    """The store of the whole memo, made once per application and read by
    the queries that do not change it."""
    path = _place(spark, root, "memo")
    made = memo.MemoTable(spark, path, partitions=MEMO_PARTITIONS)
    if made.is_new():
        made.store(_memo(spark, root))
    return made


def _page_responses(spark, root):
    return derived.page_response_envelopes(_conv(spark, root))


def _benchmark_queries(spark, root):
    return _t(spark, root, "benchmark", ["item_id", "text"]).select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _place(spark, root, kind):
    place = hashlib.md5(f"{spark.sparkContext.applicationId} {root}".encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/askbatch-{kind}-{place}"


def _index(spark, root, kind, build):
    """The index of a table at its place in the shared folder: written by the
    first query of the application that asks for it, read by the others."""
    path = _place(spark, root, f"index-{kind}")
    if retrieval.CorpusIndex.exists(spark, path):
        return retrieval.CorpusIndex.load(spark, path)
    return build().materialize(path)


def _page_index(spark, root):
    def build():
        md = html_to_markdown(_heavy(_pages(spark, root)))
        return retrieval.build_index(md, id_col="page_id", text_col="markdown")
    return _index(spark, root, "pages", build)


def _doc_index(spark, root):
    def build():
        return retrieval.build_index(_t(spark, root, "documents", ["doc_id", "text", "lang"]))
    return _index(spark, root, "documents", build)


# ---- ops ------------------------------------------------------------------

def q_scan_search_responses(spark, root):
    return _results(spark, root)


def q_fetch_join(spark, root):
    return _fetch(spark, root)[0]


def q_fetch_failures(spark, root):
    return _fetch(spark, root)[1]


def q_memo_store(spark, root):
    """The memo, then a later batch whose keys it holds already."""
    table = _new_memo(spark, _memo(spark, root))
    qa = derived.qa_pairs(_conv(spark, root))
    table.store(qa.filter(F.col("answer").contains("\n")), F.timestamp_seconds(F.lit(MEMO_NEW_EPOCH)))
    return table.read().select("question", "answer", F.unix_seconds("stored_at").alias("stored_ts"))


def q_generate_entries(spark, root):
    """The customers as keyed entries."""
    c = _t(spark, root, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])
    address = F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"))
    phone = F.concat(F.lit("555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return memo.keyed_entries(c, F.col("c_custkey"), F.col("c_name"), address, phone)


def q_valid_questions(spark, root):
    blanks = spark.createDataFrame(BLANK_QUESTIONS, "question_id long, question string")
    qs = _questions(spark, root).select("question_id", "question").unionByName(blanks)
    return questions.valid_questions(qs)


def q_search_failures(spark, root):
    return search_failures(_searches(spark, root))


def _responses(spark, root):
    conv = _conv(spark, root)
    return derived.page_response_envelopes(conv).unionByName(derived.final_response_envelopes(conv))


def q_parse_responses(spark, root):
    return exchange.parse_responses(_responses(spark, root))


def q_response_failures(spark, root):
    return exchange.response_failures(_responses(spark, root))


def q_normalize_query(spark, root):
    extra = spark.createDataFrame(SITE_QUESTIONS, "question_id long, question string")
    qs = _questions(spark, root).select("question_id", "question").unionByName(extra)
    return questions.normalize_query(qs).select("question_id", "query")


def q_memo_hits(spark, root):
    return _memo_table(spark, root).lookup(_questions(spark, root).select("question_id", "question"))[0]


def q_memo_misses(spark, root):
    return _memo_table(spark, root).lookup(_questions(spark, root).select("question_id", "question"))[1]


def q_memo_exists(spark, root):
    return _memo_table(spark, root).exists(_questions(spark, root).select("question_id", "question"))


def q_memo_delete(spark, root):
    conv = _conv(spark, root)
    table = _new_memo(spark, _memo(spark, root))
    table.delete(conv.filter((F.col("role") == "user") & (F.col("turn") == 0)).select(F.col("text").alias("question")))
    return table.read().select("question", "answer")


def q_collect_page_answers(spark, root):
    content = exchange.parse_responses(_page_responses(spark, root))
    got = exchange.collect_page_answers(content)
    return got.select("question_id", F.to_json("answers").alias("answers_json"), "n_answers")


def q_assemble_document(spark, root):
    return documents.assemble_document(derived.doc_pages_from_conversations(_conv(spark, root)))


def q_results_listing(spark, root):
    return listing.results_listing(_results(spark, root))


def q_memo_size(spark, root):
    return memo.memo_size(_memo(spark, root))


def q_stage_counts(spark, root):
    searches = _searches(spark, root)
    # the narrow tables of the flow: results, and the page picked for each
    results = checkpointed(_asked_results(spark, root), "results")
    picks = checkpointed(pick_pages(results, _snapshot(spark, root)), "picks")
    fetch_fail = fetch_failures(picks)
    fetched = fetched_picks(picks)
    asked = searches.select("question_id").unionByName(results.select("question_id"))
    return stats.stage_counts(asked, results=results, fetched=fetched,
                              failures=search_failures(searches).unionByName(fetch_fail))


def q_failure_counts(spark, root):
    searches = _searches(spark, root)
    fetch_fail = _fetch(spark, root)[1]
    resp_fail = exchange.response_failures(_responses(spark, root))
    return stats.failure_counts(search_failures(searches).unionByName(fetch_fail).unionByName(resp_fail))


def q_retrieve_topk(spark, root):
    return retrieval.retrieve_topk(_benchmark_queries(spark, root), _doc_index(spark, root), k=5)


def _page_links(spark, root):
    return links.extract_links(_heavy(_pages(spark, root)))


def q_retrieve_topk_pruned(spark, root):
    """The same ranking by threshold and block maxima."""
    return retrieval.retrieve_topk(_benchmark_queries(spark, root), _doc_index(spark, root), k=5, prune=True)


def q_retrieve_by_market(spark, root):
    """Each benchmark item searched in the market of its number."""
    mkt = F.element_at(F.array(*[F.lit(m) for m in MARKETS]), (F.col("qid") % len(MARKETS) + 1).cast("int"))
    qs = _benchmark_queries(spark, root).withColumn("mkt", mkt)
    return retrieval.retrieve_topk(qs, _doc_index(spark, root), k=5, mkt_col="mkt")


def q_distinct_links(spark, root):
    return links.distinct_links(links.resolve_links(_page_links(spark, root)))


def q_memo_flush(spark, root):
    """Keys of the store before and after it is emptied."""
    before, after = _new_memo(spark, _memo(spark, root)).flush()
    return spark.createDataFrame([(before, after)], "n_before long, n_after long")


def q_build_requests_format(spark, root):
    return exchange.build_format_requests(_questions(spark, root))


def q_build_requests_page(spark, root):
    qs = _benchmark_queries(spark, root)
    ranked = retrieval.retrieve_topk(qs, _page_index(spark, root), k=5)
    pages = _pages(spark, root)
    # k rows per query, read by the fetch join and its size check: cut once
    results = checkpointed(
        ranked.join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
              .select(F.col("qid").alias("question_id"), (F.col("rank") - 1).alias("pos"), "url"))
    fetched, _ = fetch_join(results, _heavy(pages.withColumn("status", F.lit(200))))
    questions_df = qs.select(F.col("qid").alias("question_id"), F.col("query").alias("question"))
    return exchange.build_page_requests(html_to_markdown(fetched), questions_df)


def q_build_requests_final(spark, root):
    content = exchange.parse_responses(_page_responses(spark, root))
    return exchange.build_final_requests(_questions(spark, root), exchange.collect_page_answers(content))


def q_html_to_markdown(spark, root):
    return html_to_markdown(_heavy(_pages(spark, root))).select("page_id", "url", "markdown")


def q_find_pdf_links(spark, root):
    pages = _heavy(_pages(spark, root)).withColumn("html", F.regexp_replace("html", *PDF_REWRITE))
    return links.find_pdf_links(pages)


def q_resolve_links(spark, root):
    page_links = _page_links(spark, root).select("page_url", "href")
    cases = spark.createDataFrame(URL_CASES, "page_url string, href string")
    return links.resolve_links(page_links.unionByName(cases)).distinct()


def q_extract_links(spark, root):
    return _page_links(spark, root)


def q_extract_passages(spark, root):
    qs = _benchmark_queries(spark, root)
    docs = _t(spark, root, "documents", ["doc_id", "text"])
    top = retrieval.retrieve_topk(qs, _doc_index(spark, root), k=5)
    # k rows a query meet the scan of the texts; no text is shuffled for it
    top = checkpointed(top.select("qid", "doc_id"), "top")
    pairs = docs.join(F.broadcast(top) if fits_broadcast(top) else top, "doc_id").select("qid", "doc_id", "text")
    return retrieval.extract_passages(pairs, qs, n=1)


def q_prepare_answers(spark, root):
    return _prepared(spark, root).page_requests


def _sink(spark, step, sink, columns):
    """One output of a step, read from the write of all of them."""
    path = scratch_path(spark, "sinks")
    write_sinks(step, path)
    return read_sink(spark, path, sink, columns)


def q_prepare_hits(spark, root):
    return _sink(spark, _prepared(spark, root), "hits", ["question_id", "question", "answer"])


def q_prepare_failures(spark, root):
    return _sink(spark, _prepared(spark, root, by_search=True), "failures", ["question_id", "stage", "key", "reason"])


def q_prepare_from_searches(spark, root):
    return _sink(spark, _prepared(spark, root, by_search=True), "page_requests",
                 ["request_id", "question_id", "kind", "pos", "body"])


def q_finish_answers(spark, root):
    conv = _conv(spark, root)
    empty_memo = spark.createDataFrame([], MEMO)
    done = finish_answers(_twice_asked(spark, root), derived.page_response_envelopes(conv),
                          derived.final_response_envelopes(conv), empty_memo)
    return done.answers


def q_finish_requests(spark, root):
    return _sink(spark, _finished(spark, root), "final_requests", ["request_id", "question_id", "kind", "pos", "body"])


def q_finish_memo(spark, root):
    return _finished(spark, root).memo.select("question", "answer")


# Markets of the queries, by number; null: all languages.
MARKETS = ("en-us", "fr-fr", None, "de-de", "es-es")

# The review-and-search-again query.
REFINE_FIRST_MKT = "en-us"
REFINE_MIN_SCORE = 20.0


def q_refine_search(spark, root):
    def build():
        docs = _t(spark, root, "documents", ["doc_id", "text", "lang"])
        return retrieval.build_index(docs, mkt=REFINE_FIRST_MKT)
    narrow = _index(spark, root, "documents-" + REFINE_FIRST_MKT, build)
    return refine_answers(_benchmark_queries(spark, root), [narrow, _doc_index(spark, root)],
                          k=5, min_score=REFINE_MIN_SCORE)


# Fixed value: terms that a relaxed query drops before any page will do.
RELAX_ROUNDS = 20


def q_relaxed_search(spark, root):
    return retrieval.relaxed_search(_benchmark_queries(spark, root), _doc_index(spark, root), k=5, rounds=RELAX_ROUNDS)


def q_format_queries(spark, root):
    conv = _conv(spark, root)
    got, _ = exchange.queries_from_format_responses(
        _twice_asked(spark, root).select("question_id", "question"), derived.format_response_envelopes(conv))
    return got.select("question_id", "query")


def q_pdf_link_counts(spark, root):
    return stats.link_counts(q_find_pdf_links(spark, root))


QUERIES: dict[str, Query] = {
    "scan_search_responses": q_scan_search_responses,
    "fetch_join": q_fetch_join,
    "fetch_failures": q_fetch_failures,
    "memo_store": q_memo_store,
    "generate_entries": q_generate_entries,
    "valid_questions": q_valid_questions,
    "search_failures": q_search_failures,
    "parse_responses": q_parse_responses,
    "response_failures": q_response_failures,
    "normalize_query": q_normalize_query,
    "memo_hits": q_memo_hits,
    "memo_misses": q_memo_misses,
    "memo_exists": q_memo_exists,
    "memo_delete": q_memo_delete,
    "collect_page_answers": q_collect_page_answers,
    "assemble_document": q_assemble_document,
    "results_listing": q_results_listing,
    "memo_size": q_memo_size,
    "stage_counts": q_stage_counts,
    "failure_counts": q_failure_counts,
    "retrieve_topk": q_retrieve_topk,
    "retrieve_topk_pruned": q_retrieve_topk_pruned,
    "retrieve_by_market": q_retrieve_by_market,
    "distinct_links": q_distinct_links,
    "memo_flush": q_memo_flush,
    "build_requests_format": q_build_requests_format,
    "build_requests_page": q_build_requests_page,
    "build_requests_final": q_build_requests_final,
    "html_to_markdown": q_html_to_markdown,
    "find_pdf_links": q_find_pdf_links,
    "resolve_links": q_resolve_links,
    "extract_links": q_extract_links,
    "extract_passages": q_extract_passages,
    "prepare_answers": q_prepare_answers,
    "prepare_hits": q_prepare_hits,
    "prepare_failures": q_prepare_failures,
    "prepare_from_searches": q_prepare_from_searches,
    "finish_answers": q_finish_answers,
    "finish_requests": q_finish_requests,
    "finish_memo": q_finish_memo,
    "refine_search": q_refine_search,
    "relaxed_search": q_relaxed_search,
    "pdf_link_counts": q_pdf_link_counts,
    "format_queries": q_format_queries,
}
