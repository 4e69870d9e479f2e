"""Paged documents -> one text per document (op 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# pages per first-level chunk
CHUNK_PAGES = 1024


def _ordered_join(key_col: str, text_col: str):
    parts = F.array_sort(F.collect_list(F.struct(F.col(key_col).alias("k"), F.col(text_col).alias("t"))))
    return F.array_join(F.transform(parts, lambda x: x["t"]), "")


def assemble_document(doc_pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no",
                      text_col: str = "text", chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """(doc_id, text, n_pages): page texts in page order, nothing between
    them, null pages skipped.

    Two levels, so a document with a huge number of pages is not sorted and
    joined in one task: runs of `chunk_pages` consecutive pages are joined in
    parallel, then the chunks of a document are joined in order. The output
    is one text per document, so that final row is as large as the document.
    """
    chunks = (doc_pages
              .withColumn("_chunk", F.floor(F.col(page_col) / F.lit(chunk_pages)))
              .groupBy(id_col, "_chunk")
              .agg(_ordered_join(page_col, text_col).alias("_text"), F.count(F.lit(1)).alias("_n")))
    return (chunks.groupBy(id_col)
            .agg(_ordered_join("_chunk", "_text").alias("text"), F.sum("_n").cast("long").alias("n_pages")))
