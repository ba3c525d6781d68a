"""Connected components by alternating large and small stars.

Every step is a grouped minimum (combined before the shuffle) and an
equi-join; links never reach the driver. A node with very many links isn't one
task's: its minimum is broadcast with those of the few like it. Each round's
links are written to the shared folder, so lineage stays one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hub_join, stored


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return hub_join(both, low, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = hub_join(down, low, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (u long, v long), any direction, repeats allowed.

    Returns (node, root): each node that has a link to another node, with the
    smallest node of its component. Empty links: empty result. Raises if
    max_rounds do not settle it (rounds grow with the logarithm of the size)."""
    spark = links.sparkSession
    now, path = stored(links.where("u <> v").select("u", "v").distinct(), "links")
    was = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        was, old = mark, path
        now, path = stored(_small_star(_large_star(now, mark[0]), mark[0]), "links")
        discard(spark, old)
    raise RuntimeError("components did not settle")
