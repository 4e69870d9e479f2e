"""Bulk HTML -> markdown (op 21): one narrow projection, no UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import markdown_document


def html_to_markdown(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                     out: str = "markdown", keep_html: bool = False) -> DataFrame:
    """Add `source: {url} \\n{markdown}\\n\\n`; a null page gives null."""
    df = pages.withColumn(out, markdown_document(F.col(url_col), F.col(html_col)))
    return df if keep_html else df.drop(html_col)
