"""Boxes as four Columns in picture fractions, and the scalar rules over them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """x and y of the upper left corner, width and height, each a fraction of the picture."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*(F.col(f"{prefix}{k}") for k in "xywh"))

    def columns(self, prefix: str = "") -> list[Column]:
        return [v.alias(f"{prefix}{k}") for k, v in zip("xywh", self, strict=True)]

    @property
    def area(self) -> Column:
        return self.w * self.h


def clamp(b: Box) -> Box:
    """Inside the picture: corners to 0..1, sides to what is left."""
    x, y = (F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in (b.x, b.y))
    return Box(x, y, F.greatest(F.least(b.w, 1 - x), F.lit(0.0)), F.greatest(F.least(b.h, 1 - y), F.lit(0.0)))


def to_pixels(b: Box, width: int, height: int, pad: float | Column = 0.0) -> list[Column]:
    """(x0, y0, x1, y1) of the box grown by ``pad`` of its side on each side; halves round to even."""
    px, py = b.w * pad, b.h * pad
    edge = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(size), F.rint(v * size).cast("int")))
    return [edge(b.x - px, width).alias("x0"), edge(b.y - py, height).alias("y0"), edge(b.x + b.w + px, width).alias("x1"), edge(b.y + b.h + py, height).alias("y1")]


def from_pixels(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Box:
    return clamp(Box(x0 / width, y0 / height, (x1 - x0) / width, (y1 - y0) / height))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def contains(outer: Box, inner: Box, fraction: float) -> Column:
    """At least ``fraction`` of ``inner`` is inside; false for an empty one."""
    return (inner.area > 0) & (intersection(outer, inner) >= fraction * inner.area)


def smaller_overlap(a: Box, b: Box) -> Column:
    least = F.least(a.area, b.area)
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def grow(b: Box, fraction: float) -> Box:
    """``fraction`` of each side added on both sides, cut at the picture."""
    return clamp_edges(b.x - fraction * b.w, b.y - fraction * b.h, b.x + (1 + fraction) * b.w, b.y + (1 + fraction) * b.h)


def clamp_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
    a, b, c, d = (F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in (x0, y0, x1, y1))
    return Box(a, b, c - a, d - b)


def center(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / 2, b.y + b.h / 2


def lerp(a: Box, b: Box, t: Column) -> Box:
    return Box(*(p + (q - p) * t for p, q in zip(a, b, strict=True)))


def near(a: Box, b: Box, reach: Column | float) -> Column:
    """Sizes within a factor of two, centres no farther apart than ``reach`` of the largest side."""
    size_a, size_b = F.greatest(a.w, a.h), F.greatest(b.w, b.h)
    ratio = size_a / F.when(size_b > 0, size_b)
    (ax, ay), (bx, by) = center(a), center(b)
    return F.coalesce(ratio.between(0.5, 2.0), F.lit(False)) & (F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= F.greatest(size_a, size_b) * reach)


def inside_of(outer: Box, inner: Box) -> Box:
    """A box given in fractions of ``outer``, in fractions of the picture."""
    return Box(outer.x + inner.x * outer.w, outer.y + inner.y * outer.h, inner.w * outer.w, inner.h * outer.h)


def unletterbox(v: Column, offset: Column | float, ratio: Column | float, size: int) -> Column:
    return F.least(F.greatest((v - offset) / ratio, F.lit(0.0)), F.lit(float(size)))


def tiles(size: int, tile: int, overlap: float) -> Column:
    """Start offsets of the tiles that cover ``size``; the last one ends at the edge."""
    if size <= tile:
        return F.array(F.lit(0))
    step = max(1, int(tile * (1 - overlap)))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), F.lit(size - tile), F.lit(step)), F.array(F.lit(size - tile))))


def covered_share(b: Box, covers: Column, n: int) -> Column:
    """Share of the n x n cell centres of ``b`` that any of ``covers`` (array of x0, y0, x1, y1 structs) holds, edges included."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.struct((b.x + b.w * ((k % n) + 0.5) / n).alias("px"), (b.y + b.h * (F.floor(k / n) + 0.5) / n).alias("py")))
    hit = lambda p: F.exists(covers, lambda c: p["px"].between(c["x0"], c["x1"]) & p["py"].between(c["y0"], c["y1"]))
    return F.size(F.filter(cells, hit)) / F.lit(n * n)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector over its length; null for a zero one."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


STANDARD_RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0)  # fixed values


def nearest_rate(fps: Column) -> Column:
    """The closest usual frame rate within 8 %, else the rate itself to three places; 30 where it is not positive."""
    rates = F.array(*[F.lit(r) for r in STANDARD_RATES])
    best = F.array_min(F.transform(rates, lambda r: F.struct(F.abs(r - fps).alias("d"), r.alias("r"))))
    return F.when(fps > 0, F.when(best["d"] <= 0.08 * fps, best["r"]).otherwise(F.round(fps, 3))).otherwise(F.lit(30.0))


def time_text(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    return F.format_string("%02d:%02d:%06.3f", F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), seconds - 60 * F.floor(seconds / 60))


def to_frame(seconds: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.rint(seconds * fps)).otherwise(F.lit(0.0)).cast("long")


def to_time(frame: Column, fps: Column) -> Column:
    return F.when(fps > 0, frame / fps).otherwise(F.lit(0.0))
