"""Edits of tracks whose spans carry their keyframes: one row per span.

A row holds ``media_id, track_id, span_no, start_frame, end_frame`` and ``keys``, an array of (frame, x, y, w, h) in frame
order; other columns are carried.  What a span decides alone is an expression over its array; what the whole track decides
takes one window over its spans.  Spans of a track don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, clamp

KEY = "struct<frame: bigint, x: double, y: double, w: double, h: double>"
TRACK = ["media_id", "track_id"]


def key(frame: Column | int, box: Box) -> Column:
    at = frame if isinstance(frame, Column) else F.lit(frame)
    return F.struct(at.cast("bigint").alias("frame"), *[v.cast("double").alias(k) for k, v in zip("xywh", box, strict=True)])


def nest(spans: DataFrame, keys: DataFrame) -> DataFrame:
    """Spans with the keyframes that lie in them; both are keyed by track, and a track's keyframes bound a group."""
    k = keys.groupBy(*TRACK).agg(F.array_sort(F.collect_list(key(F.col("frame"), Box.of()))).alias("keys"))
    inside = F.filter(F.coalesce("keys", F.array().cast(f"array<{KEY}>")), lambda k: k["frame"].between(F.col("start_frame"), F.col("end_frame")))
    return spans.join(k, TRACK, "left").withColumn("keys", inside)


def flatten(nested: DataFrame) -> DataFrame:
    return nested.select(*TRACK, "span_no", F.explode("keys").alias("k")).select(*TRACK, "span_no", "k.*")


def box_at(keys: Column, frame: Column) -> Column:
    """The keyframe's struct at ``frame``: interpolated between its neighbours, held beyond the ends; null without keys."""
    before = F.array_max(F.filter(keys, lambda k: k["frame"] <= frame))
    after = F.array_min(F.filter(keys, lambda k: k["frame"] >= frame))
    t = (frame - before["frame"]) / (after["frame"] - before["frame"])
    mixed = key(frame, Box(*(before[c] + (after[c] - before[c]) * t for c in "xywh")))
    held = F.coalesce(before, after)
    moved = key(frame, Box(*(held[c] for c in "xywh")))
    return F.when(held.isNull(), F.lit(None)).when(before.isNull() | after.isNull() | (before["frame"] == after["frame"]), moved).otherwise(mixed)


def put(keys: Column, one: Column) -> Column:
    """``keys`` with ``one`` in the place of what is at its frame; unchanged if ``one`` is null."""
    rest = F.filter(keys, lambda k: k["frame"] != one["frame"])
    return F.when(one.isNull(), keys).otherwise(F.array_sort(F.concat(rest, F.array(one))))


def holds(frame: Column) -> Column:
    return frame.between(F.col("start_frame"), F.col("end_frame"))


def trim_start(nested: DataFrame, frame: int | Column) -> DataFrame:
    """Only what lies at ``frame`` or after it; a span cut there keeps its box as a keyframe."""
    f = frame if isinstance(frame, Column) else F.lit(frame)
    cut = F.col("start_frame") < f
    left = put(F.filter("keys", lambda k: k["frame"] >= f), box_at(F.col("keys"), f))
    return nested.where(F.col("end_frame") >= f).withColumn("keys", F.when(cut, left).otherwise(F.col("keys"))).withColumn("start_frame", F.when(cut, f).otherwise(F.col("start_frame")))


def trim_end(nested: DataFrame, frame: int | Column) -> DataFrame:
    """Only what lies at ``frame`` or before it."""
    f = frame if isinstance(frame, Column) else F.lit(frame)
    cut = F.col("end_frame") > f
    left = put(F.filter("keys", lambda k: k["frame"] <= f), box_at(F.col("keys"), f))
    return nested.where(F.col("start_frame") <= f).withColumn("keys", F.when(cut, left).otherwise(F.col("keys"))).withColumn("end_frame", F.when(cut, f).otherwise(F.col("end_frame")))


def split_at(nested: DataFrame, frame: int) -> DataFrame:
    """``part`` 0 before ``frame`` and 1 from it on; a track with no box there, or that begins there, stays whole (0)."""
    f, w = F.lit(frame), W.partitionBy(*TRACK)
    can = F.max(holds(f) & (F.size("keys") > 0)).over(w) & (F.min("start_frame").over(w) < f)
    seen = nested.withColumn("can split", F.coalesce(can, F.lit(False)))
    cut = seen.where("`can split`")
    parts = trim_end(cut, frame - 1).withColumn("part", F.lit(0)).unionByName(trim_start(cut, frame).withColumn("part", F.lit(1)))
    return seen.where("not `can split`").withColumn("part", F.lit(0)).unionByName(parts).drop("can split")


def merge_touching(nested: DataFrame) -> DataFrame:
    """Spans of a track that overlap or adjoin as one, with the keyframes of all; the first span's other columns stay."""
    w = W.partitionBy(*TRACK).orderBy("start_frame", "end_frame", "span_no")
    reach = F.max("end_frame").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = nested.withColumn("run ", F.sum(F.when(F.col("start_frame") <= reach + 1, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rest = [c for c in nested.columns if c not in (*TRACK, "start_frame", "end_frame", "keys")]
    order = F.struct("start_frame", "end_frame", "span_no")
    merged = runs.groupBy(*TRACK, "run ").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.array_sort(F.flatten(F.collect_list("keys"))).alias("keys"), *[F.min_by(c, order).alias(c) for c in rest])
    return merged.select(*nested.columns)


def _nearest(nested: DataFrame, frame: int) -> tuple[DataFrame, Column, Column]:
    """(rows, is the frame inside a span of the track, is this the span nearest to it)."""
    f = F.lit(frame)
    away = F.least(F.abs(F.col("start_frame") - f), F.abs(F.col("end_frame") - f))
    rank = F.row_number().over(W.partitionBy(*TRACK).orderBy(away, "start_frame", "span_no"))
    rows = nested.withColumn("inside ", F.max(holds(f)).over(W.partitionBy(*TRACK))).withColumn("rank ", rank)
    return rows, F.col("inside "), F.col("rank ") == 1


def extend_to(nested: DataFrame, frame: int) -> DataFrame:
    """The span nearest to ``frame`` reaches it, where the track does not yet; its end box is held."""
    rows, inside, nearest = _nearest(nested, frame)
    grow = ~inside & nearest
    grown = rows.select(*[
        F.when(grow, F.least(c, F.lit(frame))).otherwise(F.col(c)).alias(c) if c == "start_frame" else F.when(grow, F.greatest(c, F.lit(frame))).otherwise(F.col(c)).alias(c) if c == "end_frame" else F.col(c)
        for c in nested.columns
    ])
    return merge_touching(grown)


def set_key(nested: DataFrame, frame: int, box: tuple[float, float, float, float]) -> DataFrame:
    """A keyframe at ``frame``; in a gap, the nearest span reaches for it."""
    rows, inside, nearest = _nearest(nested, frame)
    one = key(frame, Box(*map(F.lit, box)))
    here = F.when(inside, holds(F.lit(frame))).otherwise(nearest)
    grown = rows.withColumn("keys", F.when(here, put(F.col("keys"), one)).otherwise(F.col("keys")))
    grown = grown.withColumn("here ", here).withColumn("start_frame", F.when(F.col("here "), F.least("start_frame", F.lit(frame))).otherwise(F.col("start_frame")))
    grown = grown.withColumn("end_frame", F.when(F.col("here "), F.greatest("end_frame", F.lit(frame))).otherwise(F.col("end_frame")))
    return merge_touching(grown.select(*nested.columns))


def correct(nested: DataFrame, frame: int, box: tuple[float, float, float, float], scope: str = "frame") -> DataFrame:
    """``box`` at ``frame``, and the same change of centre and size on the keyframes in ``scope`` (frame, onward, back,
    track).  ``n_changed`` counts a span's other keyframes that changed; a track without a box at ``frame`` changes no other."""
    f = F.lit(frame)
    old = F.max(F.when(holds(f), box_at(F.col("keys"), f))).over(W.partitionBy(*TRACK))
    done = set_key(nested.withColumn("old ", old), frame, box)
    was, (x, y, w, h) = F.col("old "), map(F.lit, box)
    sw, sh = F.when(was["w"] > 1e-6, w / was["w"]).otherwise(1.0), F.when(was["h"] > 1e-6, h / was["h"]).otherwise(1.0)
    dx, dy = x + w / 2 - was["x"] - was["w"] / 2, y + h / 2 - was["y"] - was["h"] / 2
    hit = {"frame": lambda at: F.lit(False), "onward": lambda at: at > f, "back": lambda at: at < f, "track": lambda at: at != f}[scope]
    applies = lambda k: was.isNotNull() & hit(k["frame"])

    def change(k: Column) -> Column:
        new = Box(k["x"] + k["w"] / 2 + dx - k["w"] * sw / 2, k["y"] + k["h"] / 2 + dy - k["h"] * sh / 2, k["w"] * sw, k["h"] * sh)
        return F.when(applies(k), key(k["frame"], clamp(new))).otherwise(k)

    return done.withColumn("n_changed", F.size(F.filter("keys", applies))).withColumn("keys", F.transform("keys", change)).drop("old ")


def remove_key(nested: DataFrame, frame: int) -> DataFrame:
    """Without the keyframe at ``frame``; a span left without any goes."""
    had = F.exists("keys", lambda k: k["frame"] == frame)
    rest = nested.withColumn("had ", had).withColumn("keys", F.filter("keys", lambda k: k["frame"] != frame))
    return rest.where(~F.col("had ") | (F.size("keys") > 0)).drop("had ")


def full_picture(ranges: DataFrame) -> DataFrame:
    """(media_id, track_id, start_frame, end_frame) as tracks of the entire picture; the ends may be given in either order."""
    first, last = F.least("start_frame", "end_frame"), F.greatest("start_frame", "end_frame")
    note = F.concat(F.lit("entire picture redacted, frames "), first.cast("string"), F.lit("-"), last.cast("string"))
    whole = F.array(key(first, Box(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))))
    return ranges.select(*TRACK, F.lit(0).cast("bigint").alias("span_no"), first.alias("start_frame"), last.alias("end_frame"), whole.alias("keys"), F.lit("entire picture").alias("label"), F.lit("rect").alias("shape"), F.lit(0.0).alias("pad"), F.lit("manual").alias("source"), note.alias("note"))
