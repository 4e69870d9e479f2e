"""Streaming runs of the narrow operators equal their batch runs."""

from pyspark.sql import functions as F

from askbatch.operators.links import extract_links, resolve_links
from askbatch.operators.memo import MemoTable
from askbatch.session import scratch_path
from askbatch.streaming.micro import links_stream, memo_upsert, read_stream, write_available

SF = "/root/testdata/sf0.001"


def test_links_stream_equals_batch(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    src = scratch_path(spark, "pages-src")
    pages.repartition(3).write.parquet(src)
    out = scratch_path(spark, "links-out")
    write_available(links_stream(read_stream(spark, src, pages.schema, 1)), out)
    got = spark.read.parquet(out)
    want = resolve_links(extract_links(pages))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_memo_upsert_per_batch(spark):
    src = scratch_path(spark, "answers-src")
    spark.createDataFrame([("q1", "a1", 1), ("q2", "a2", 1)], "question string, answer string, ts long") \
        .select("question", "answer", F.timestamp_seconds("ts").alias("stored_at")).write.parquet(src)
    store = MemoTable(spark, scratch_path(spark, "memo-stream"))
    memo_upsert(read_stream(spark, src, "question string, answer string, stored_at timestamp"), store)
    assert dict((r.question, r.answer) for r in store.read().collect()) == {"q1": "a1", "q2": "a2"}


def test_response_parsing_stream_equals_batch(spark):
    from askbatch.operators.exchange import parse_responses
    from askbatch.plans import catalog as C
    from askbatch.sources import derived
    responses = derived.page_response_envelopes(C._conv(spark, SF))
    src = scratch_path(spark, "responses-src")
    responses.repartition(2).write.parquet(src)
    out = scratch_path(spark, "parsed-out")
    write_available(parse_responses(read_stream(spark, src, responses.schema, 1)), out)
    got = spark.read.parquet(out)
    want = parse_responses(responses)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0
