"""Plain suppression and the rules for rows of a plate detector, as array expressions over the boxes of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import Box

BOX = "struct<worse:double,det_no:long,x:double,y:double,w:double,h:double>"

# Fixed values of the plate rules, in pixels of the detector's square input.
INPUT = 384
LEAST_W, LEAST_H = 6, 3
ASPECT = (1.1, 8.0)
LARGEST = 0.35
LEAST_FRAME_W, LEAST_FRAME_H = 4, 3
PAD_Y = 0.10
SAME_PLATE = 0.55
MOST = 20


def _field(b: Column) -> Box:
    return Box(*(b[k] for k in "xywh"))


def best_apart(boxes: Column, most: float) -> Column:
    """Of an array of (worse, det_no, x, y, w, h), best first: each box that overlaps no better one kept by more than ``most``."""
    overlaps = lambda kept, b: F.exists(kept, lambda k: g.iou(_field(k), _field(b)) > most)
    return F.aggregate(boxes, F.array().cast(f"array<{BOX}>"), lambda kept, b: F.when(overlaps(kept, b), kept).otherwise(F.concat(kept, F.array(b))))


def suppress(dets: DataFrame, by: list[str], most: float, limit: int | None = None) -> DataFrame:
    """(by, det_no, score, box) kept by plain suppression within a group of ``by``, which holds a frame's few boxes.

    Equal scores go by det_no.  ``limit`` keeps the best of a group after suppression.
    """
    box = F.struct((-F.col("score")).alias("worse"), F.col("det_no").cast("long").alias("det_no"), *Box.of().columns()).cast(BOX)
    each = dets.groupBy(*by).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kept = best_apart(F.col("boxes"), most)
    out = each.select(*by, F.explode(kept if limit is None else F.slice(kept, 1, limit)).alias("b"))
    return out.select(*by, F.col("b.det_no").alias("det_no"), (-F.col("b.worse")).alias("score"), *_field(F.col("b")).columns())


def plate_boxes(rows: DataFrame, picture: tuple[int, int], ratio: float, offset: tuple[float, float], least: float) -> DataFrame:
    """Rows (det_no, x0, y0, x1, y1, score and others), in pixels of the letterboxed input, that look like a plate, as boxes of the picture.

    A little height is added so that the frame of the plate is covered.  Values that are no finite number fall out.
    """
    corner = ["x0", "y0", "x1", "y1"]
    finite = F.lit(True)
    for c in (*corner, "score"):
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sound = finite & F.col("score").between(least, 1.001) & (w >= LEAST_W) & (h >= LEAST_H) & (w / h).between(*ASPECT) & (w * h <= LARGEST * INPUT * INPUT)
    width, height = picture
    edges = {c: g.unletterbox(F.col(c), offset[i % 2], ratio, picture[i % 2]) for i, c in enumerate(corner)}
    seen = rows.where(sound).withColumns(edges).where((F.col("x1") - F.col("x0") >= LEAST_FRAME_W) & (F.col("y1") - F.col("y0") >= LEAST_FRAME_H))
    pad = (F.col("y1") - F.col("y0")) * PAD_Y
    box = g.from_pixels(F.col("x0"), F.greatest(F.col("y0") - pad, F.lit(0.0)), F.col("x1"), F.least(F.col("y1") + pad, F.lit(float(height))), width, height)
    return seen.select(*[c for c in rows.columns if c not in corner], *box.columns())


def plates(rows: DataFrame, by: list[str], picture: tuple[int, int], ratio: float, offset: tuple[float, float], least: float) -> DataFrame:
    """The plates of each frame: sound rows, one box per plate, the best twenty."""
    return suppress(plate_boxes(rows, picture, ratio, offset, least), by, SAME_PLATE, MOST)
