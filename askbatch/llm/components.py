"""Connected components of a link table by alternating star contraction.

Each round points the neighbours of a node to the smallest identifier around
it, first the larger neighbours (large star), then the smaller ones (small
star); it ends when the links no longer change, after a number of rounds that
grows with the logarithm of the longest chain. Every round is a pre-aggregated
minimum and an equi-join whose skewed keys Spark splits; links are cut to a
table in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _star(links: DataFrame, both: bool) -> DataFrame:
    """links (u, v) with v < u. `both`: large star, else small star."""
    around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else links
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if both:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest
    identifier reachable. Links to itself and null ends are ignored."""
    now = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    state = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
        now = checkpointed(_star(_star(now, True), False), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
