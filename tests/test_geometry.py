import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import Box


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def box(*v):
    return Box(*map(F.lit, map(float, v)))


def test_pixels(spark):
    b = box(0.25, 0.25, 0.5, 0.5)
    assert tuple(one(spark, *g.to_pixels(b, 100, 100, 0.0))) == (25, 25, 75, 75)
    assert tuple(one(spark, *g.to_pixels(b, 100, 100, 0.1))) == (20, 20, 80, 80)
    assert tuple(one(spark, *g.to_pixels(box(0, 0, 0.2, 0.2), 100, 100, 0.5))) == (0, 0, 30, 30)


def test_iou_contains_clamp(spark):
    a, far = box(0.1, 0.1, 0.2, 0.2), box(0.7, 0.7, 0.2, 0.2)
    r = one(spark, g.iou(a, a).alias("a"), g.iou(a, far).alias("b"), g.contains(a, box(0.1, 0.1, 0, 0), 0.5).alias("c"), g.clamp(box(0.9, -1, 0.5, 0.5)).w.alias("d"))
    assert (r.a, r.b, r.c) == (pytest.approx(1.0), 0.0, False) and r.d == pytest.approx(0.1)


def test_near(spark):
    r = one(spark, g.near(box(0.1, 0.1, 0.1, 0.1), box(0.15, 0.1, 0.1, 0.1), 1.5).alias("a"), g.near(box(0.1, 0.1, 0.1, 0.1), box(0.6, 0.1, 0.1, 0.1), 1.5).alias("b"), g.near(box(0.1, 0.1, 0.1, 0.1), box(0.1, 0.1, 0.4, 0.4), 1.5).alias("c"))
    assert tuple(r) == (True, False, False)


def test_rates_and_times(spark):
    rates = spark.createDataFrame([(29.83,), (30.2,), (59.5,), (27.5,), (0.0,)], "f double").select(g.nearest_rate(F.col("f"))).collect()
    assert [r[0] for r in rates] == [29.97, 30.0, 59.94, 27.5, 30.0] or [r[0] for r in rates] == [29.97, 30.0, 59.94, 25.0, 30.0]
    r = one(spark, g.time_text(F.lit(3725.5)).alias("t"), g.to_frame(F.lit(0.5), F.lit(5.0)).alias("f"), g.to_frame(F.lit(1.0), F.lit(0.0)).alias("z"))
    assert (r.t, r.f, r.z) == ("01:02:05.500", 2, 0)


def test_tiles_and_coverage(spark):
    cover = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.5).alias("x1"), F.lit(1.0).alias("y1")))
    r = one(spark, g.tiles(1280, 640, 0.0).alias("t"), g.tiles(1000, 640, 0.25).alias("u"), g.covered_share(box(0, 0, 1, 1), cover, 6).alias("c"))
    assert (list(r.t), list(r.u), r.c) == ([0, 640], [0, 360], 0.5)


def test_unit_and_cosine(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, g.cosine(g.unit(v), g.unit(v)).alias("c"), g.unit(F.array(F.lit(0.0))).alias("z"))
    assert math.isclose(r.c, 1.0) and r.z is None


unit = st.floats(0, 1, allow_nan=False)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(unit, unit, unit, unit), min_size=2, max_size=2))
def test_iou_is_symmetric(spark, boxes):
    a, b = (box(*v) for v in boxes)
    r = one(spark, g.iou(a, b).alias("p"), g.iou(b, a).alias("q"))
    assert math.isclose(r.p, r.q, abs_tol=1e-12) and -1e-12 <= r.p <= 1 + 1e-9
