"""The narrow operators over file streams, and the memo upsert per batch.

Markdown, links, search-response and model-response parsing are row-local,
so they apply unchanged to a `readStream` source. Answers arriving as a stream
are merged into the memo store once per micro-batch with `foreachBatch`. A
store is last-write-wins, so replaying a batch after a failure writes the
same content again (storing twice equals storing once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.links import extract_links, resolve_links
from ..operators.markdown import html_to_markdown
from ..operators.memo import MemoTable
from ..session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: StructType | str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder as a stream; new files are picked up as they land."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def links_stream(pages: DataFrame) -> DataFrame:
    """(page_url, pos, href, text, link_url) for each page as it arrives."""
    return resolve_links(extract_links(pages))


def markdown_stream(pages: DataFrame) -> DataFrame:
    return html_to_markdown(pages)


def write_available(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append to a parquet folder, processing what is there, then stop."""
    spark = df.sparkSession
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return q


def memo_upsert(answers: DataFrame, store: MemoTable, checkpoint: str | None = None,
                available_now: bool = True) -> StreamingQuery:
    """Merge each micro-batch of (question, answer[, stored_at]) into the store."""
    spark = answers.sparkSession

    def _merge(batch: DataFrame, epoch_id: int) -> None:
        if not batch.isEmpty():
            store.store(batch)

    w = (answers.writeStream.foreachBatch(_merge)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "memo-ckpt")))
    q = (w.trigger(availableNow=True) if available_now else w).start()
    if available_now:
        q.awaitTermination()
    return q
