"""HTML -> markdown as a column: `pagetext.markdown` over Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .pagetext import markdown

# source line format (space before the newline)
SOURCE_PREFIX = "source: "
SOURCE_SUFFIX = " \n"
BODY_SUFFIX = "\n\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# pages taken out of an Arrow batch together
SLICE = 256


def _markdown(pages: pa.Array) -> pa.Array:
    # bytes that are not UTF-8 read as replacement characters, as in the JVM
    parts = [pa.array([None if x is None else markdown(x.decode("utf-8", "replace")) for x in pages.slice(at, SLICE).to_pylist()],
                      pa.string()) for at in range(0, len(pages), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def markdown_body(html: Column | str) -> Column:
    """Markdown text of an HTML string (null stays null)."""
    ship_package(SparkSession.active())
    return F.arrow_udf(_markdown, "string")(_col(html).cast("binary"))


def markdown_document(url: Column | str, html: Column | str) -> Column:
    """`source: {url} \\n{markdown}\\n\\n`, the page text sent to the model."""
    return F.concat(F.lit(SOURCE_PREFIX), _col(url), F.lit(SOURCE_SUFFIX),
                    markdown_body(html), F.lit(BODY_SUFFIX))
