"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package  # noqa: F401

# The word pattern and the letters folded by `ascii_lower`.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast path of `lower`."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def whole_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def with_group_totals(rows: DataFrame, key: str, salt: str, parts: DataFrame,
                      totals: dict[str, Column]) -> DataFrame:
    """Join every row to the totals of its group without gathering a group.

    `parts` has one pre-aggregated row per (key, salt); its columns feed the
    `totals` aggregates. A group has at most as many parts as there are salts,
    so the totals are computed over a bounded list, and the join runs on
    (key, salt): a key that holds a third of all rows is spread over all salts.
    """
    groups = parts.groupBy(key).agg(
        F.collect_list(salt).alias("_salts"),
        *[c.alias(n) for n, c in totals.items()])
    spread = groups.select(key, F.explode("_salts").alias(salt), *totals)
    return rows.join(spread, [key, salt])


def numpy_threads_off() -> None:
    """One thread per task for native libraries inside Python workers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
