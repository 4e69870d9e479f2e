"""Search responses: scan into result rows (op 1) and classify failures (op 6).

`searches(question_id, status, body)` holds one HTTP response per question.
The body is parsed once into a VARIANT; bad JSON (null variant) is told apart
from a missing key, which a permissive `from_json` cannot do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SEARCH_ITEMS, STAGE_SEARCH

# Failure reasons of a search response, checked in this order.
REASON_HTTP = "http_status"
REASON_BAD_JSON = "bad_json"
REASON_EMPTY = "empty_response"
REASON_NO_WEBPAGES = "no_webPages"
REASON_NO_VALUE = "no_value"
# JSON values that count as "no results" (falsy in the reference)
FALSY_JSON = ["{}", "[]", "null", "false", "0", '""']


def _parsed(searches: DataFrame) -> DataFrame:
    # parse once, cast the result list once; the checks below read columns
    return (searches.withColumn("_v", F.try_parse_json("body"))
            .withColumn("_items", F.try_variant_get("_v", "$.webPages.value", SEARCH_ITEMS)))


def _items() -> F.Column:
    return F.col("_items")


def _reason() -> F.Column:
    v = F.col("_v")
    return (F.when(F.col("status").isNull() | (F.col("status") != 200), F.lit(REASON_HTTP))
             .when(v.isNull(), F.lit(REASON_BAD_JSON))
             # only a body without the key can be empty, so no other is written out
             .when(F.try_variant_get(v, "$.webPages", "variant").isNull(),
                   F.when(F.to_json(v).isin(*FALSY_JSON), F.lit(REASON_EMPTY)).otherwise(F.lit(REASON_NO_WEBPAGES)))
             .when(_items().isNull(), F.lit(REASON_NO_VALUE)))


def scan_search_responses(searches: DataFrame) -> DataFrame:
    """results(question_id, pos, id, name, url, snippet), one per item.

    Narrow: a filter and a generator, no shuffle. `pos` is the position in
    `webPages.value`, so order never depends on arrival.
    """
    return (_parsed(searches)
            .filter(_reason().isNull())
            .select("question_id", F.posexplode(_items()).alias("pos", "item"))
            .select("question_id", F.col("pos").cast("long").alias("pos"),
                    "item.id", "item.name", "item.url", "item.snippet"))


def search_failures(searches: DataFrame) -> DataFrame:
    """failures(question_id, stage, key, reason): one row per bad response."""
    return (_parsed(searches)
            .withColumn("reason", _reason())
            .filter(F.col("reason").isNotNull())
            .select("question_id", F.lit(STAGE_SEARCH).alias("stage"),
                    F.when(F.col("reason") == REASON_HTTP, F.col("status").cast("string"))
                     .alias("key"),
                    "reason"))
