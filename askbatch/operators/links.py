"""Links on pages: extract (op 24), resolve (op 23), PDF links (op 22) and
distinct links (op 18). All narrow except the final `distinct`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import anchor_href, anchor_text, page_anchors, resolve_url
from ..schemas import STAGE_LINKS

PDF_SUFFIX = ".pdf"


def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per anchor with an href, in page order:
    (*keep, page_url, pos, href, text). `text` is collapsed, and
    `Unnamed link` when empty."""
    found = pages.select(*keep, F.col(url_col).alias("page_url"),
                         F.posexplode(page_anchors(F.col(html_col))).alias("_i", "_a"))
    return (found.withColumn("href", anchor_href(F.col("_a.attrs"))).filter(F.col("href").isNotNull())
            .select(*keep, "page_url", F.col("_i").cast("long").alias("pos"), "href",
                    anchor_text(F.col("_a.rest")).alias("text")))


def resolve_links(links: DataFrame, base_col: str = "page_url", href_col: str = "href",
                  out: str = "link_url") -> DataFrame:
    """Add the absolute URL (RFC 3986 resolution, narrow)."""
    return links.withColumn(out, resolve_url(F.col(base_col), F.col(href_col)))


def distinct_links(links: DataFrame, cols: tuple[str, ...] = ("page_url", "link_url")) -> DataFrame:
    """Unique links per page (one shuffle, partial dedupe map-side)."""
    return links.select(*cols).distinct()


def _searched(pages: DataFrame, html_col: str) -> Column:
    """A page that was downloaded: it has content, and status 200 if the
    snapshot records one."""
    ok = F.col(html_col).isNotNull()
    return ok & F.coalesce(F.col("status") == 200, F.lit(False)) if "status" in pages.columns else ok


def find_pdf_links(pages: DataFrame, suffix: str = PDF_SUFFIX, url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Unique absolute links of downloaded pages whose trimmed, lower-cased
    href ends with `suffix` (`x.pdf?dl=1` does not): (page_url, link_url)."""
    links = extract_links(pages.filter(_searched(pages, html_col)), url_col, html_col)
    pdf = links.filter(F.lower(F.col("href")).endswith(F.lit(suffix.lower())))
    return distinct_links(resolve_links(pdf))


def link_failures(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A page that was not downloaded cannot be searched for links."""
    reason = F.lit("no_content")
    if "status" in pages.columns:
        reason = F.when(F.coalesce(F.col("status") == 200, F.lit(False)), reason).otherwise(
            F.concat(F.lit("http_status "), F.coalesce(F.col("status").cast("string"), F.lit("-"))))
    return (pages.filter(~_searched(pages, html_col))
            .select(F.lit(None).cast("long").alias("question_id"), F.lit(STAGE_LINKS).alias("stage"),
                    F.col(url_col).alias("key"), reason.alias("reason")))
