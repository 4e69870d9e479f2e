"""Page snapshots and the fetch join (op 2).

The engine makes no network calls: a crawl lands as a table
`pages(url, html, status)`; a result whose URL has no row, or a row whose
status is not 200, is a failed fetch and becomes a `failures` row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STAGE_FETCH
from ..session import checkpointed, fits_broadcast

# Fetch failure reasons.
REASON_NOT_FETCHED = "not_fetched"
REASON_HTTP = "http_status"

DEFAULT_BROADCAST_ROWS = 1_000_000


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Read a snapshot written as parquet; a missing status means 200."""
    df = spark.read.parquet(path)
    if "status" not in df.columns:
        df = df.withColumn("status", F.lit(200))
    return df


def snapshot_from_pages(pages: DataFrame) -> DataFrame:
    """Snapshot view of the driver's `pages` table: every row is a page that
    was downloaded (status 200), whether or not it has its end tag."""
    return pages.select("page_id", "url", "html", F.lit(200).alias("status"))


def _versions(pages: DataFrame) -> DataFrame:
    """The snapshot with `version`, which of several crawls of a URL counts:
    the highest page_id, or, where the table has none, a digest of the page."""
    version = F.coalesce("page_id", F.lit(-1 << 63)) if "page_id" in pages.columns else F.xxhash64("html")
    return pages.withColumn("version", version.cast("long"))


def pick_pages(results: DataFrame, pages: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(question_id, pos, url, version, status, found, copies), one row per
    result: the crawl of its URL that counts. Only narrow columns of the
    snapshot are read and shuffled, and a URL without a row stays, with nulls."""
    keys = results.select("question_id", "pos", "url")
    seen = _versions(pages).select("url", "version", "status", F.col("html").isNotNull().alias("found"))
    matched = seen.join(F.broadcast(keys) if fits_broadcast(keys, broadcast_rows) else keys, "url")
    crawls = (matched.groupBy("question_id", "pos", "url", "version")
              .agg(F.max("status").alias("status"), F.max("found").alias("found"), F.count(F.lit(1)).alias("copies")))
    none = keys.select("question_id", "pos", "url", F.lit(None).cast("long").alias("version"),
                       F.lit(None).cast("int").alias("status"), F.lit(False).alias("found"), F.lit(0).cast("long").alias("copies"))
    best = F.max_by(F.struct("url", "version", "status", "found", "copies"),
                    F.struct((F.col("copies") > 0).alias("a"), "version", "url"))
    return (crawls.select(*none.columns).unionByName(none).groupBy("question_id", "pos").agg(best.alias("b"))
            .select("question_id", "pos", "b.*"))


def fetched_picks(picks: DataFrame) -> DataFrame:
    """The picks that were downloaded."""
    return picks.filter((F.col("status") == 200) & F.col("found"))


def fetch_picked(picks: DataFrame, pages: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                 of_page: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(question_id, pos, url, html) of the picks that were downloaded: one
    scan of the page texts, filtered by the picks. With `of_page` it has what
    that makes of (url, html) instead of html: it is given each page once, and
    the rows are dealt to the results that asked for the page after it."""
    wanted = fetched_picks(picks).select("question_id", "pos", "url", "version", "copies")
    texts = _versions(pages).filter(F.col("html").isNotNull()).select("url", "version", "html")

    def fetched(rows: DataFrame) -> DataFrame:
        side = F.broadcast(rows) if fits_broadcast(rows, broadcast_rows) else rows
        return texts.join(side, ["url", "version"]).select("question_id", "pos", "url", "html")

    def dealt(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("url", "version").agg(F.collect_list(F.struct("question_id", "pos")).alias("asked"))
        side = F.broadcast(asked) if fits_broadcast(rows, broadcast_rows) else asked
        made = of_page(texts.join(side, ["url", "version"]).select("url", "html", "asked"))
        columns = [c for c in made.columns if c != "asked"]
        return made.select(F.explode("asked").alias("a"), *columns).select("a.*", *columns)

    # of rows that repeat a URL and a page_id the largest text counts; there
    # are none in a sound crawl, and only these are grouped
    repeated = wanted.filter("copies > 1").drop("copies")
    once = wanted.filter("copies = 1").drop("copies")
    once = dealt(once) if of_page else fetched(once)
    if repeated.isEmpty():
        return once
    largest = fetched(repeated).groupBy("question_id", "pos", "url").agg(F.max("html").alias("html"))
    return once.unionByName(of_page(largest) if of_page else largest)


def fetch_failures(picks: DataFrame) -> DataFrame:
    return (picks.filter(~((F.coalesce(F.col("status"), F.lit(0)) == 200) & F.col("found")))
            .select("question_id", F.lit(STAGE_FETCH).alias("stage"), F.col("url").alias("key"),
                    F.when(F.col("status").isNull(), F.lit(REASON_NOT_FETCHED))
                     .otherwise(F.concat(F.lit(REASON_HTTP + " "), F.col("status").cast("string")))
                     .alias("reason")))


def fetch_join(results: DataFrame, pages: DataFrame, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
               of_page: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fetched, failures) for result rows `(question_id, pos, url, ...)`.

    The crawl of each URL that counts is picked on narrow columns and written
    down (a row per result); then the page texts are scanned once. The result
    side is small next to a crawl: under `broadcast_rows` it is broadcast in
    both steps and no page text is shuffled.
    """
    picks = checkpointed(pick_pages(results, pages, broadcast_rows), "picks")
    return fetch_picked(picks, pages, broadcast_rows, of_page), fetch_failures(picks)
