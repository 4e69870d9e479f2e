"""Bounded training samples and splits for the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo `folds` (null identifier: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def stratified_sample(labelled: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """At most `per_class` rows of each class, the ones whose identifier has
    the smallest hash, with `_weight` = rows of the class / rows sampled, so
    that the sample stands for the class sizes of the whole table. Only
    identifiers and classes are shuffled."""
    rows = labelled.select(id_col, class_col).filter(
        F.col(id_col).isNotNull() & F.col(class_col).isNotNull()).distinct()
    # the first `per_class` of each salt hold the first ones of the class, and
    # no class is gathered in one task
    order = (F.xxhash64(id_col), F.col(id_col))
    top = rows.withColumn("_salt", F.pmod(F.hash(id_col), F.lit(64)))
    for group in ((class_col, "_salt"), (class_col,)):
        top = top.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(
            F.col("_rn") <= per_class)
    sizes = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"))
    return (top.join(sizes, class_col)      # one row per class
            .withColumn("_weight", F.col("_n") / F.least(F.col("_n"), F.lit(per_class)))
            .drop("_rn", "_n", "_salt"))
