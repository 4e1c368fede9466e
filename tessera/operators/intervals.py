"""Islands, overlap joins by bins, and interpolation between keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, lerp


def islands(df: DataFrame, by: list[str], start: str, end: str, apart: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """``df`` with ``island``: rows of a key share one as long as each starts no later than the ends before it.

    ``apart`` is the condition that parts a row from those before, over ``reach_`` (the largest end before it); the default
    joins what overlaps or touches.
    """
    w = W.partitionBy(*by).orderBy(start, end, *(tie or []))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    reach = df.withColumn("reach_", F.max(end).over(before))
    new = F.col("reach_").isNull() | (F.col(start) > F.col("reach_") if apart is None else apart)
    return reach.withColumn("island", F.sum(new.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("reach_")


def merge_ranges(df: DataFrame, by: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Overlapping or touching ranges of a key as one, with the number of rows in each; empty ranges are dropped."""
    return islands(df.where(F.col(end) > F.col(start)), by, start, end).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def merge_spans(df: DataFrame, by: list[str]) -> DataFrame:
    """Inclusive frame spans that overlap or adjoin, as one."""
    joined = islands(df, by, "start_frame", "end_frame", F.col("start_frame") > F.col("reach_") + 1)
    return joined.groupBy(*by, "island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("n_spans")).drop("island")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], bin_width: float, left_range: tuple[str, str], right_range: tuple[str, str], closed: bool = True) -> DataFrame:
    """Pairs of rows with equal ``on`` whose ranges overlap, by bins of the axis as an equi-join key.

    A pair that shares several bins is kept in the bin where the later of the two starts, so no distinct is needed.
    """
    (a, b), (c, d) = left_range, right_range
    binned = lambda df, s, e, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor(F.col(e) / bin_width))))
    x, y = binned(left.where(F.col(b) >= F.col(a)), a, b, "bin_"), binned(right.where(F.col(d) >= F.col(c)), c, d, "bin_")
    meets = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) if closed else (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    return x.join(y, [*on, "bin_"]).where(meets & (F.col("bin_") == F.floor(F.greatest(F.col(a), F.col(c)) / bin_width))).drop("bin_")


def interpolate(frames: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Box of each (key, frame): between keyframes a straight mix, before the first and after the last that one's box.

    Frames and keyframes are sorted once per key and carry the last keyframe forward and the next one back.
    """
    marked = frames.select(*by, "frame", F.lit(None).cast("struct<f:long,x:double,y:double,w:double,h:double>").alias("k"))
    known = keys.select(*by, "frame", F.struct(F.col("frame").cast("long").alias("f"), "x", "y", "w", "h").alias("k"))
    w = W.partitionBy(*by).orderBy("frame", F.col("k").isNull())
    both = known.withColumn("asked", F.lit(False)).unionByName(marked.withColumn("asked", F.lit(True)))
    near = both.select(*by, "frame", "asked", F.last("k", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("a"), F.first("k", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("b")).where("asked")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    t = F.when(b["f"] > a["f"], (F.col("frame") - a["f"]) / (b["f"] - a["f"])).otherwise(F.lit(0.0))
    box = lerp(Box(*(a[k] for k in "xywh")), Box(*(b[k] for k in "xywh")), t)
    return near.select(*by, "frame", *box.columns()).where("x is not null")


def gap_runs(df: DataFrame, by: list[str], at: str, step: int) -> DataFrame:
    """Runs of points no farther than ``step`` apart: start, end, points, and frames = end - start + step."""
    w = W.partitionBy(*by).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > step, F.lit(True))
    runs = df.withColumn("new_", new.cast("long")).withColumn("run", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min(at).alias("start_frame"), F.max(at).alias("end_frame"), F.count("*").alias("points")).withColumn("frames", F.col("end_frame") - F.col("start_frame") + step).drop("run")
