"""Search results as one text block per question (op 14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results_listing(results: DataFrame) -> DataFrame:
    """(question_id, listing, n_results): `id\\nname\\nurl\\nsnippet\\n\\n`
    per result in `pos` order; a missing field prints as empty. One result
    counts per position (the largest block, if they differ)."""
    block = F.concat(*[F.concat(F.coalesce(F.col(c), F.lit("")), F.lit("\n"))
                       for c in ("id", "name", "url", "snippet")], F.lit("\n"))
    # a result delivered twice is reduced before its question collects
    one = results.groupBy("question_id", "pos").agg(F.max(block).alias("b"))
    return (one.groupBy("question_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("_r"))
            .select("question_id", F.array_join(F.transform("_r", lambda x: x["b"]), "").alias("listing"),
                    F.size("_r").cast("long").alias("n_results")))
