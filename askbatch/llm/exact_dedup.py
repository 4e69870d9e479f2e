"""Exact dedup by content sort, DataFrame functions only.

Sampled splitters range-partition the rows by their normalised content: the
first characters, then the length, then a salt. Splitters are short, so the
sample sent to the driver stays small for any text length. Within a partition an
external sort puts equal texts next to each other, and the window cuts the rows
into runs by comparing neighbours by their whole normalised content; the first
row of a run in the order of the sort is the one that stays.

The salt is zero for all rows but those of a (prefix, length) group with more
than LARGE rows, counted beforehand on a hash of the two: such a group, which
may hold a third of all rows, is cut into salts of about LARGE rows. So all
copies of an ordinary text are neighbours in one run, and the sort alone
decides. Only the runs of a text in a salted group are merged afterwards, by the
SHA-256 of the content, one narrow row per run.

Edge cases: a null text counts as empty. A null identifier loses to any other
and stays only in a group that has no identifier at all. Rows repeated with the
same identifier and text form one group of which exactly one row stays. An
empty table gives an empty result. Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import ascii_lower, whole_text, with_group_totals

PREFIX_CHARS = 48           # characters of a splitter
LARGE = 4096                # rows of a (prefix, length) group that stay together
BROADCAST_GROUPS = 1 << 20  # groups above LARGE that are broadcast, 12 bytes each
SPREAD = 64                 # parts of a group's rows in the join beyond that


def _salted(rows: DataFrame, large: int, broadcast_groups: int) -> DataFrame:
    """Add `_parts`, null for an ordinary group, else its number of salts, and
    `_salt`. At most one group per `large` rows is in the table of large groups."""
    sizes = checkpointed(
        rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large)
        .select("_group", F.ceil(F.col("_n") / large).cast("int").alias("_parts")), "exact-large-groups")
    if sizes.count() <= broadcast_groups:
        joined = rows.join(F.broadcast(sizes), "_group", "left")
    else:
        spread = sizes.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined = (rows.withColumn("_spread", F.pmod(F.xxhash64("_id", "_text"), F.lit(SPREAD)).cast("int"))
                  .join(spread, ["_group", "_spread"], "left").drop("_spread"))
    return joined.withColumn("_salt", F.coalesce(
        F.pmod(F.xxhash64(F.lit("salt"), "_id", "_text"), F.col("_parts")).cast("int"), F.lit(0)))


def content_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                 large: int = LARGE, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """What the sort finds, one row per input row: _id, _salt, _parts (null
    unless the group was salted), _rn (place in its run), _run_id (the run's
    identifier that stays), _run_n (rows of the run), text_sha256."""
    best = F.max if keep == "largest" else F.min
    first = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()
    text = whole_text(F.col("_text"))
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .select("_id", "_text",
                ascii_lower(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix"),
                F.char_length(text).alias("_len"))
        .withColumn("_group", F.xxhash64("_prefix", "_len")))
    ranged = (_salted(rows, large, broadcast_groups)
              .repartitionByRange("_prefix", "_len", "_salt")
              .select("_id", "_prefix", "_len", "_salt", "_parts", ascii_lower(text).alias("_norm")))
    run = Window.partitionBy("_prefix", "_len", "_salt", "_norm").orderBy(first)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return checkpointed(
        ranged.select(
            "_id", "_salt", "_parts", "_norm",
            F.row_number().over(run).alias("_rn"),
            best("_id").over(whole).alias("_run_id"),
            F.count(F.lit(1)).over(whole).alias("_run_n"))
        .select("_id", "_salt", "_parts", "_rn", "_run_id", "_run_n",
                F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256")),
        "exact-dedup")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "largest", large: int = LARGE, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    `keep` says which identifier of a group of equal texts stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best, by = (F.max, F.max_by) if keep == "largest" else (F.min, F.min_by)
    rows = content_runs(docs, id_col, text_col, keep, large, broadcast_groups)
    together = rows.filter("_parts is null").select(
        "_id", "_salt", "_rn", "text_sha256", F.col("_run_id").alias("keep_id"), F.col("_run_n").alias("group_size"),
        F.lit(True).alias("_best_run"))
    cut = rows.filter("_parts is not null")
    runs = cut.filter("_rn = 1").select("text_sha256", "_salt", "_run_id", "_run_n")
    merged = with_group_totals(
        cut, "text_sha256", "_salt", runs,
        {"keep_id": best("_run_id"), "group_size": F.sum("_run_n"),
         # of the runs that hold the identifier, one: repeated rows may lie in several
         "_best_salt": F.coalesce(by("_salt", "_run_id"), F.min("_salt"))})
    apart = merged.select("_id", "_salt", "_rn", "text_sha256", "keep_id", "group_size",
                          (F.col("_salt") == F.col("_best_salt")).alias("_best_run"))
    return together.unionByName(apart).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_best_run") & F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_rn") == 1)).alias("kept"),
        "text_sha256")
