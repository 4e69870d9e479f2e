"""Counts the answering flow reports (op 16).

Each input is aggregated on its own (partial + final, keyed by
question_id) and the aggregates are joined from the question list, so a
question with no results or failures shows zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("question_id").agg(F.count(F.lit(1)).alias(name))


def stage_counts(questions: DataFrame, **stages: DataFrame) -> DataFrame:
    """(question_id, n_<stage>...) for each keyword table of question rows."""
    out = questions.select("question_id").distinct()
    for name, df in stages.items():
        out = out.join(_count(df, f"n_{name}"), "question_id", "left")
    return out.fillna(0, subset=[f"n_{n}" for n in stages])


def failure_counts(failures: DataFrame) -> DataFrame:
    """(stage, reason, n) over a failures table."""
    return failures.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def link_counts(links: DataFrame) -> DataFrame:
    """(page_url, n_links): unique links per page."""
    return links.groupBy("page_url").agg(F.count_distinct("link_url").alias("n_links"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, counting its rows while whatever job runs it runs:
    (frame, observation), the count under `rows` once the job is done. Nothing
    is computed again for the count."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
