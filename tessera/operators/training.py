"""Boxes as training rows, tracker output tied to detections, spans held on after a loss, a log of changes, hits on a timeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import Box
from tessera.operators import greedy, tracks
from tessera.operators.intervals import merge_spans, overlap_join

#: Common object classes that matter for privacy, by their number in the usual list of eighty (fixed values).
PRIVACY_CLASSES = {0: "person", 2: "vehicle", 3: "vehicle", 5: "vehicle", 7: "vehicle", 62: "screen", 63: "screen", 64: "mouse", 66: "keyboard", 67: "phone", 73: "document"}


def privacy_label(number: Column, classes: dict[int, str] | None = None) -> Column:
    """The label of a class number; null for one that does not matter."""
    pairs = [F.lit(v) for kv in (classes or PRIVACY_CLASSES).items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), number.cast("int"))


def split_clips(clips: DataFrame, clip: str, share: float = 0.15) -> DataFrame:
    """(``clip``, split): about ``share`` of the clips, one at least, are ``val``, by a hash of their name, so a clip never is in both."""
    place = F.conv(F.substring(F.md5(F.col(clip).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    each = clips.select(clip).distinct().withColumn("place_", place)
    least = each.agg(F.min_by(clip, F.struct("place_", clip)).alias("least_"))
    got = each.join(F.broadcast(least))  # one row
    return got.select(clip, F.when((F.col("place_") < share) | (F.col(clip) == F.col("least_")), "val").otherwise("train").alias("split"))


def annotations(boxes: DataFrame, classes: list[str], width: int, height: int, least_side: float = 0, share: float = 0.15) -> DataFrame:
    """Rows for training: split by medium, class numbered from 1, box and area in pixels; boxes under ``least_side`` are left out."""
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int")
    px = Box(F.col("x") * width, F.col("y") * height, F.col("w") * width, F.col("h") * height)
    big = boxes.where(F.col("label").isin(*classes) & (px.w >= least_side) & (px.h >= least_side))
    rows = big.select("det_no", "media_id", "frame", number.alias("category_id"), *px.columns("b"), px.area.alias("area"))
    return rows.join(split_clips(boxes, "media_id", share), "media_id")


def tied(tracked: DataFrame, dets: DataFrame, least: float = 0.3) -> DataFrame:
    """(media_id, frame, track_id, det_no) of a tracker's boxes (media_id, frame, track_id, box) and the frame's detections.

    Tracks go by their number; each takes the free detection that it overlaps best, by ``least`` at least, the first of equals.
    """
    known = tracked.select("media_id", "frame", F.col("track_id").alias("det_no"), F.lit(0).alias("side"), *"xywh")
    seen = dets.select("media_id", "frame", "det_no", F.lit(1).alias("side"), *"xywh")

    def each(pdf) -> list[tuple]:
        sides = pdf["side"].to_numpy()
        a, b = pdf[sides == 0], pdf[sides == 1]
        if not len(a) or not len(b):
            return []
        over, free, out = greedy.iou_matrix(a[["x", "y", "w", "h"]].to_numpy(float), b[["x", "y", "w", "h"]].to_numpy(float)), np.ones(len(b), bool), []
        for i in range(len(a)):
            j = int(np.argmax(np.where(free, over[i], -1)))
            if free[j] and over[i, j] >= least:
                free[j] = False
                out.append((int(a["media_id"].iloc[0]), int(a["frame"].iloc[0]), int(a["det_no"].iloc[i]), int(b["det_no"].iloc[j])))
        return out

    return greedy.by_frames(known.unionByName(seen), ["media_id", "frame"], "media_id long, frame long, track_id long, det_no long", each)


def held(spans: DataFrame, hold: int, step: int, last: int) -> DataFrame:
    """Spans (media_id, track_id) kept on for ``hold`` frames at both ends and to the end of the last step, merged where they meet."""
    start, end = tracks.extend(F.col("start_frame"), F.col("end_frame"), hold, hold + step - 1, last)
    return merge_spans(spans.select("media_id", "track_id", start.alias("start_frame"), end.alias("end_frame")), ["media_id", "track_id"])


def hits(points: DataFrame, ranges: DataFrame, bin_width: float = 30.0) -> DataFrame:
    """``points`` (media_id, t) with the ranges (media_id, start_s, end_s and others) under them, ends included."""
    return overlap_join(points.withColumn("t_", F.col("t")), ranges, ["media_id"], bin_width, ("t", "t_"), ("start_s", "end_s")).drop("t_")


def logged(before: DataFrame, after: DataFrame, by: list[str], what: str) -> DataFrame:
    """(``by``, action) of what was added to or removed from a project between two states, as log rows."""
    gone, new = before.select(*by).distinct(), after.select(*by).distinct()
    return new.join(gone, by, "left_anti").withColumn("action", F.lit(f"add_{what}")).unionByName(gone.join(new, by, "left_anti").withColumn("action", F.lit(f"remove_{what}")))
