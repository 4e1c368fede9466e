"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SALTS = 8


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root): root is the smallest node of the component; nodes without edge are absent.

    Each round rewires every node to the smallest neighbour it knows, so the rounds follow the logarithm of a component's
    diameter; each round is a written table, and the one before is deleted.  A hub's rows are summed (map side first) or
    joined to one row in ``SALTS`` tasks.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """Neighbours (above the node for the large star, below it and itself for the small star) -> the least one."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = pairs.where("v > u") if larger else pairs
        dealt = hung.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))  # a hub's rows go to several tasks
        met = dealt.join(least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "s"])
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")) if not larger else hung.sparkSession.createDataFrame([], "u long, v long"))

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(star(both, True).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        then = materialize(star(large, False).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        n = then.count()
        same = n == now.count() and then.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(now, large)
        now = then
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
