"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by the MD5 of their identifier and queued,
pass after pass, up to `max_epochs` times. The virtual finish time of a queued
copy is the number of source words up to and including it, divided by the
weight of the source. All copies are cut into ranges of virtual time and taken
in that order until the budget is used up; the first copy that would exceed it
ends the mix. A source that has queued all its passes drops out and the others
share what it leaves, which is what the targets say in closed form: the level
V with sum(min(cap_s, w_s * V)) = budget.

Running sums never gather a source or the table: a source is cut into about
sqrt(n) runs of its shuffled order and virtual time into about sqrt(N) ranges;
sums per run are pre-aggregated, offsets come from the sums, and only rows of
one run are sorted together.

Edge cases: a null source is a source of its own, ranked last; a null or empty
text has size 0 and is never taken; a null identifier shuffles like the empty
string; rows with equal identifiers are queued one after the other by size. If
all sizes are 0, targets and takings are 0. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import WORD, whole_text

# Fixed values of the mix: weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: rank, weight, n, source_size, level, target.

    Works on one pre-aggregated row per source; the ranking and the running
    sums over sources are the only steps in one task.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = (
        per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_w", F.sum("weight").over(everything)))
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    levelled = ranked.withColumn(
        "v", (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), zero))
        / (F.col("all_w") - F.coalesce(F.sum("weight").over(earlier), zero)))
    return (
        levelled.withColumn("level", F.max(F.when(F.col("v") <= F.col("cap") / F.col("weight"), F.col("v")))
                            .over(everything))
        # no level: the budget exceeds all caps
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap"))
                    .otherwise(F.least("cap", F.col("weight") * F.col("level"))))
        .select("source", "rank", "weight", "n", "source_size", "budget", "level", "target"))


def _running(rows: DataFrame, keys: list[str], group: list[str], order: list, out: str) -> DataFrame:
    """Running sum of size in `group` order: keys = group + run number."""
    run_sums = rows.groupBy(*keys).agg(F.sum("size").alias("_run"))
    before = Window.partitionBy(*group).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = run_sums.select(*keys, F.coalesce(F.sum("_run").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.join(offsets, keys)
            .withColumn(out, F.col("_before") + F.sum("size").over(within)).drop("_before"))


def weighted_fair_schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           source_col: str = "source", weights=WEIGHTS, share: float = SHARE,
                           max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: id, source, size, source_size, target, weight,
    cum (source words up to this document) and copies, how often it is taken."""
    spark = docs.sparkSession
    sizes = checkpointed(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                    F.regexp_count(whole_text(F.col(text_col)), F.lit(WORD)).cast("long").alias("size")),
        "mix-sizes")
    targets = checkpointed(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    digest = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary"))
    queued = (
        sizes.join(targets.withColumnRenamed("source", "_source"),
                   F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_u", digest)
        .withColumn("_run_no", F.floor(
            F.conv(F.substring("_u", 1, 8), 16, 10).cast("double")
            / F.lit(2.0 ** 32) * F.ceil(F.sqrt(F.col("n").cast("double"))))))
    queued = _running(queued, ["rank", "_run_no"], ["rank"], [F.col("_u"), F.col("_id"), F.col("size")], "cum")
    queued = checkpointed(queued.drop("_u", "_run_no"), "mix-queue")

    # ranges of virtual time: about sqrt(copies) up to the level; later times,
    # which the cut passes only by the size of a few documents, share coarser ones
    n_rows = targets.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, math.isqrt(int(n_rows) * max_epochs))
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    copies = (
        queued.filter("size > 0")
        .select("rank", "weight", "size", "budget", "level", "source_size", "cum", F.explode(epochs).alias("epoch"))
        .withColumn("_total", F.col("epoch") * F.col("source_size") + F.col("cum"))
        .withColumn("_finish", F.col("_total") / F.col("weight"))
        .withColumn("_range", _time_range(ranges)))
    sums = copies.groupBy("_range").agg(F.sum("size").alias("s"), F.first("budget").alias("budget"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (sums.withColumn("upto", F.sum("s").over(upto))
            .filter("upto > budget").orderBy("_range").limit(1).first())
    if edge is None:       # everything fits
        cut = None
    else:                  # sort the one range in which the budget ends
        order = Window.partitionBy("_range").orderBy("_finish", "rank", "_total").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        cut = (copies.filter(F.col("_range") == edge["_range"])
               .withColumn("upto", F.lit(edge["upto"] - edge["s"]) + F.sum("size").over(order))
               .filter("upto > budget").orderBy("_finish", "rank", "_total")
               .select("_finish", "rank", "_total").limit(1).first())
    taken = F.lit(0)
    for e in range(max_epochs):
        total = F.lit(e) * F.col("source_size") + F.col("cum")
        key = F.struct((total / F.col("weight")).alias("f"), F.col("rank").alias("r"), total.alias("t"))
        inside = F.lit(True) if cut is None else key < F.struct(
            F.lit(cut["_finish"]).alias("f"), F.lit(cut["rank"]).alias("r"),
            F.lit(cut["_total"]).cast("long").alias("t"))
        taken = taken + F.when((F.col("size") > 0) & inside, 1).otherwise(0)
    return queued.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target",
                         "weight", "cum", taken.alias("copies"))


def _time_range(ranges: int):
    """Range number of a virtual finish time; monotone in the time."""
    x = F.col("_finish") / F.col("level")
    fine = F.floor(x * ranges)
    # beyond the level: ranges double in width
    coarse = F.lit(ranges) + F.floor(F.log2(x) * 64)
    return F.when(F.col("level").isNull(), F.floor(F.log2(F.col("_finish") + 1) * 64)) \
        .when(x < 1, fine).otherwise(coarse).cast("long")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", **kw) -> DataFrame:
    """The mixed documents themselves in virtual-time order, all columns as
    they came; a document taken twice is there twice.

    Rows that share identifier, source and size share the copies taken of
    them, dealt out in turn.
    """
    key = ("_id", "_source", "_size")
    plan = (weighted_fair_schedule(docs, id_col, text_col, source_col, **kw)
            .filter("copies > 0")
            .select(F.struct(F.col(id_col).alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2])).alias("_key"),
                    (F.col("cum") / F.col("weight")).alias("_f0"),
                    (F.col("source_size") / F.col("weight")).alias("_lap"), "copies")
            .groupBy("_key")
            .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"),
                 F.min("_f0").alias("_f0"), F.min("_lap").alias("_lap")))
    # the row as one struct: its own columns may have any names. Null fields of
    # the key are equal. Join and window share the key, so texts move once for
    # both: it must have one type on both sides, nullable fields included
    size = F.regexp_count(whole_text(F.col(text_col)), F.lit(WORD)).cast("long")
    sized = docs.select(
        F.struct("*").alias("_doc"),
        F.struct(F.col(id_col).alias(key[0]), F.col(source_col).alias(key[1]), size.alias(key[2]))
        .cast(plan.schema["_key"].dataType).alias("_key"))
    nth = Window.partitionBy("_key").orderBy(F.col("_doc").getField(text_col))
    share = F.floor((F.col("_copies") + F.col("_rows") - F.col("_nth")) / F.col("_rows")).cast("int")
    return (
        sized.join(plan, "_key")
        .withColumn("_nth", F.row_number().over(nth))
        .select("_doc", "_f0", "_lap", F.col("_key")[key[0]].alias("_did"), share.alias("_share"))
        .filter("_share > 0")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_share"))).alias("_epoch"))
        .select("_doc", "_did", (F.col("_f0") + (F.col("_epoch") - 1) * F.col("_lap")).alias("_finish"))
        .orderBy("_finish", "_did")
        .select("_doc.*"))
