"""Rules that let a detection through, add one, or choose a few: gates, fallbacks, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import Box
from tessera.operators.intervals import overlap_join

FRAME = ["media_id", "frame"]


def vehicle_gate(dets: DataFrame, inside: float = 0.6, margin: float = 0.08) -> DataFrame:
    """Plates with ``gated``: plate where that share lies inside a vehicle of the frame grown by ``margin``, else plate_ungated."""
    plates = dets.where("label = 'license_plate'").select("det_no", *FRAME, *Box.of().columns("p_"))
    cars = dets.where("label = 'car'").select(*FRAME, *g.grow(Box.of(), margin).columns("v_"))
    on = plates.join(cars, FRAME).where(g.contains(Box.of("v_"), Box.of("p_"), inside)).select("det_no").distinct().withColumn("on_car", F.lit(True))
    return plates.join(on, "det_no", "left").select("det_no", *FRAME, F.when(F.col("on_car"), "plate").otherwise("plate_ungated").alias("gated"))


def head_fallback(dets: DataFrame, inside: float = 0.5, width: float = 0.45, height: float = 0.22, trust: float = 0.9, least_h: float = 0.12, widest: float = 1.3) -> DataFrame:
    """A head box for each upright person of some height without a face: centred, at the top, with a part of the score."""
    persons = dets.where((F.col("label") == "person") & (F.col("h") >= least_h) & (F.col("w") <= widest * F.col("h"))).select("det_no", *FRAME, "score", *Box.of().columns())
    faces = dets.where("label = 'face'").select(*FRAME, *Box.of().columns("f_"))
    seen = persons.join(faces, FRAME).where(g.contains(Box.of(), Box.of("f_"), inside)).select("det_no").distinct()
    head = Box(F.col("x") + F.col("w") * ((1 - width) / 2), F.col("y"), F.col("w") * width, F.col("h") * height)
    return persons.join(seen, "det_no", "left_anti").select("det_no", *FRAME, *head.columns(), (F.col("score") * trust).alias("score"))


def vehicle_crops(dets: DataFrame, most: int = 4, largest: float = 0.6, side: int = 48, picture: tuple[int, int] = (1280, 720)) -> DataFrame:
    """The largest vehicles of each frame; size limits apply to those chosen, not before."""
    rank = F.row_number().over(W.partitionBy(*FRAME).orderBy(F.desc("area"), "det_no"))
    top = dets.where("label = 'car'").withColumn("area", F.col("w") * F.col("h")).withColumn("rn", rank).where(F.col("rn") <= most)
    return top.where((F.col("area") < largest) & (F.col("w") * picture[0] >= side) & (F.col("h") * picture[1] >= side)).select(*FRAME, "det_no", "area")


def ungated_continuations(gated: DataFrame, tracks: DataFrame, overlap: float = 0.3, hits: int = 2) -> DataFrame:
    """``gated`` plates (with a box) that are on a vehicle, or go on a track (media_id, hits, t_ box) that is live and confirmed.

    ``tracks`` are those live on every frame, or carry the range ``from_frame`` to ``to_frame`` in which they are.
    """
    ranged = "from_frame" in tracks.columns
    live = tracks.where(F.col("hits") >= hits).select("media_id", *(["from_frame", "to_frame"] if ranged else []), *[F.col(f"t_{k}") for k in "xywh"])
    loose = gated.where("gated = 'plate_ungated'")
    near = overlap_join(loose.withColumn("frame_", F.col("frame")), live, ["media_id"], 64, ("frame", "frame_"), ("from_frame", "to_frame")) if ranged else loose.join(live, "media_id")
    goes_on = near.where(g.iou(Box.of(), Box.of("t_")) >= overlap).select("det_no").distinct()
    return gated.where("gated = 'plate'").unionByName(gated.where("gated = 'plate_ungated'").join(goes_on, "det_no", "left_semi"))


def edge_assist(base: DataFrame, extra: DataFrame, strip: Box, inside: float = 0.25, overlap: float = 0.3) -> DataFrame:
    """``base`` with the boxes of a second pass that lie in its strip by a quarter and match no box of their label."""
    here = extra.where(g.contains(strip, Box.of(), inside))
    known = base.select(*FRAME, "label", *Box.of().columns("b_"))
    met = here.join(known, [*FRAME, "label"]).where(g.iou(Box.of(), Box.of("b_")) >= overlap).select("det_no").distinct()
    return base.unionByName(here.join(met, "det_no", "left_anti").select(base.columns))


def off_screens(documents: DataFrame, screens: DataFrame, overlap: float = 0.3) -> DataFrame:
    """Boxes of documents that no screen of their frame overlaps by more than ``overlap``."""
    other = screens.select(*FRAME, *Box.of().columns("s_"))
    hit = documents.join(other, FRAME).where(g.iou(Box.of(), Box.of("s_")) > overlap).select("det_no").distinct()
    return documents.join(hit, "det_no", "left_anti")


def snapped(drawn: DataFrame, dets: DataFrame, reach: float = 1.0) -> DataFrame:
    """Each drawn box (id, media_id, frame, label, box) with the detection of its label that it most likely means.

    The overlap counts, or nearness where there is none (centres within ``reach`` sides), both times the score.
    """
    other = dets.select(*FRAME, "label", F.col("det_no"), "score", *Box.of().columns("d_"))
    (ax, ay), (bx, by) = g.center(Box.of()), g.center(Box.of("d_"))
    far = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / F.greatest("w", "h")
    over = g.iou(Box.of(), Box.of("d_"))
    value = F.when(over > 0, over + 1).when(far <= reach, 1 - far / (reach + 1e-9)) * F.col("score")
    met = drawn.join(other, [*FRAME, "label"]).withColumn("value", value).where("value is not null")
    return met.groupBy("id").agg(F.max_by("det_no", F.struct("value", -F.col("det_no"))).alias("det_no"), F.max("value").alias("value"))


def plausible(last: Box, new: Box, late: Column, gap: Column | int = 0, speed: Column | float = 0.0) -> Column:
    """Could ``new`` be the object seen at ``last`` ``gap`` frames ago: sizes within a factor and centres within what its ``speed`` a
    frame allows, two and a half sides at least; after a long gap a wider factor and any place."""
    size_a, size_b = F.greatest(last.w, last.h), F.greatest(new.w, new.h)
    (ax, ay), (bx, by) = g.center(last), g.center(new)
    ratio = size_b / F.when((size_a > 0) & (size_b > 0), size_a)
    reach = F.greatest(2.5 * size_a, F.lit(speed) * F.lit(gap) + 2.0 * size_a)
    close = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= reach
    return F.coalesce(F.when(late, ratio.between(0.35, 3.0)).otherwise(ratio.between(0.5, 2.0) & close), F.lit(False))


def sane(new: Box, seen: Box, area: tuple[float, float] = (0.3, 3.0), aspect: tuple[float, float] = (0.55, 1.8)) -> Column:
    """Are area and aspect of a box in pixels within these ratios of the box last confirmed."""
    one = lambda v: F.greatest(v, F.lit(1.0))
    return (new.area / one(seen.area)).between(*area) & ((new.w / one(new.h)) / (seen.w / one(seen.h))).between(*aspect)


def search_region(b: Box, width: int, height: int, factor: float = 4.0, least: int = 256) -> Column:
    """Struct (x0, y0, x1, y1) of the square of ``factor`` sides around a box in pixels, moved into the picture."""
    side = F.least(F.floor(F.greatest(F.lit(float(least)), factor * F.greatest(b.w, b.h))), F.lit(max(width, height)).cast("long"))
    cx, cy = g.center(b)
    start = lambda c, size: F.floor(F.greatest(F.lit(0.0), F.least((F.lit(size) - side).cast("double"), c - side / 2)))
    x0, y0 = start(cx, width), start(cy, height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.least(F.lit(width).cast("long"), x0 + side).alias("x1"), F.least(F.lit(height).cast("long"), y0 + side).alias("y1"))


def frozen(frames: DataFrame, by: str, at: str, value: str, first: int = 12, still: float = 0.05) -> DataFrame:
    """(``by``, frames, frozen): did none of the first frames differ from the one before it by ``still`` or more."""
    w = W.partitionBy(by).orderBy(at)
    d = frames.select(by, F.row_number().over(w).alias("n"), F.abs(F.col(value) - F.lag(value).over(w)).alias("d")).where(F.col("n") <= first)
    return d.groupBy(by).agg(F.count("*").alias("frames"), ((F.count("*") > 1) & (F.coalesce(F.max("d"), F.lit(0.0)) < still)).alias("frozen"))


def scenes(frames: DataFrame, histogram: str, cut: float = 0.55, still: float = 0.02) -> DataFrame:
    """(media_id, frame, distance, kind) of frames against the one before: a ``cut``, a ``still`` or a plain one."""
    from tessera.functions.scalars import bhattacharyya

    before = F.lag(histogram).over(W.partitionBy("media_id").orderBy("frame"))
    d = frames.select(*FRAME, F.when(before.isNotNull(), bhattacharyya(F.col(histogram), before)).alias("distance")).where("distance is not null")
    return d.withColumn("kind", F.when(F.col("distance") > cut, "cut").when(F.col("distance") < still, "still").otherwise("plain"))


def moving_reach(gap: Column, fps: Column | float, still: float = 1.5, per_second: float = 3.0) -> Column:
    """How far, in sides, an object may have moved over a gap of frames: more with time, up to a second."""
    return F.when(gap <= fps, still + per_second * gap / fps).otherwise(F.lit(still))
