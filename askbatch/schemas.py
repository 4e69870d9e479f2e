"""Table shapes used across the library."""

from pyspark.sql import types as T

SEARCH_ITEMS = "array<struct<id string, name string, url string, snippet string>>"

FAILURES = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("stage", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("reason", T.StringType()),
])

MEMO = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("stored_at", T.TimestampType()),
])

# stages recorded in `failures`
STAGE_SEARCH = "search"
STAGE_FETCH = "fetch"
STAGE_MODEL = "model"
STAGE_LINKS = "links"
STAGE_QUESTION = "question"
