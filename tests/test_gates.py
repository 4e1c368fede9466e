"""Gates, snapping and small scalar rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars, text
from tessera.functions.geometry import Box
from tessera.operators import gates

DET = "det_no long, media_id long, frame long, label string, score double, x double, y double, w double, h double"


def dets(spark, *rows):
    return spark.createDataFrame(list(rows), DET)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_plate_on_a_vehicle(spark):
    d = dets(spark, (1, 1, 0, "car", 0.9, 0.5, 0.4, 0.4, 0.5), (2, 1, 0, "license_plate", 0.9, 0.6, 0.7, 0.1, 0.05), (3, 1, 0, "license_plate", 0.9, 0.1, 0.1, 0.2, 0.08), (4, 1, 1, "license_plate", 0.9, 0.6, 0.7, 0.1, 0.05))
    got = {r.det_no: r.gated for r in gates.vehicle_gate(d).collect()}
    assert got == {2: "plate", 3: "plate_ungated", 4: "plate_ungated"}
    gated = d.join(gates.vehicle_gate(d).select("det_no", "gated"), "det_no")
    tracks = spark.createDataFrame([(1, 3, 0.1, 0.1, 0.2, 0.08), (1, 1, 0.6, 0.7, 0.1, 0.05), (2, 9, 0.6, 0.7, 0.1, 0.05)], "media_id long, hits int, t_x double, t_y double, t_w double, t_h double")
    assert sorted(r.det_no for r in gates.ungated_continuations(gated, tracks).collect()) == [2, 3]


def test_head_of_a_person_without_a_face(spark):
    d = dets(spark, (1, 1, 0, "person", 0.8, 0.4, 0.1, 0.2, 0.8), (2, 1, 1, "person", 0.8, 0.4, 0.1, 0.2, 0.8), (3, 1, 1, "face", 0.9, 0.45, 0.12, 0.1, 0.1), (4, 1, 2, "person", 0.8, 0.4, 0.1, 0.2, 0.1), (5, 1, 3, "person", 0.8, 0.0, 0.0, 0.9, 0.5))
    (r,) = gates.head_fallback(d).collect()
    assert r.det_no == 1 and (r.x, r.y, r.w, r.h, r.score) == pytest.approx((0.455, 0.1, 0.09, 0.176, 0.72))


def test_crops_are_chosen_before_they_are_measured(spark):
    cars = [(k, 1, 0, "car", 0.9, 0.0, 0.0, w, w) for k, w in enumerate((0.9, 0.5, 0.4, 0.03, 0.02))]
    assert sorted(r.det_no for r in gates.vehicle_crops(dets(spark, *cars)).collect()) == [1, 2]


def test_second_pass_and_screens(spark):
    base = dets(spark, (1, 1, 0, "face", 0.9, 0.1, 0.1, 0.1, 0.1))
    extra = dets(spark, (2, 1, 0, "face", 0.4, 0.11, 0.1, 0.1, 0.1), (3, 1, 0, "face", 0.4, 0.1, 0.6, 0.1, 0.1), (4, 1, 0, "face", 0.4, 0.8, 0.6, 0.1, 0.1))
    strip = Box(*(F.lit(v) for v in (0.0, 0.0, 0.25, 1.0)))
    assert sorted(r.det_no for r in gates.edge_assist(base, extra, strip).collect()) == [1, 3]
    assert [r.det_no for r in gates.off_screens(extra, base).collect() if r.det_no == 2] == []
    assert sorted(r.det_no for r in gates.off_screens(extra, base).collect()) == [3, 4]


def test_a_drawn_box_snaps(spark):
    drawn = dets(spark, (0, 1, 0, "face", 1.0, 0.1, 0.1, 0.1, 0.1)).withColumnRenamed("det_no", "id").drop("score")
    d = dets(spark, (1, 1, 0, "face", 0.5, 0.12, 0.1, 0.1, 0.1), (2, 1, 0, "face", 0.9, 0.21, 0.1, 0.1, 0.1), (3, 1, 0, "person", 1.0, 0.1, 0.1, 0.1, 0.1), (4, 1, 0, "face", 1.0, 0.9, 0.9, 0.1, 0.1))
    (r,) = gates.snapped(drawn, d).collect()
    assert r.det_no == 1 and gates.snapped(drawn, d.where("det_no = 4")).count() == 0


def test_where_an_object_may_be_next(spark):
    box = lambda x, y, w: Box(*(F.lit(float(v)) for v in (x, y, w, w)))
    last, never, late = box(0.1, 0.1, 0.05), F.lit(False), F.lit(True)
    got = [value(spark, gates.plausible(last, b, t)) for b, t in ((box(0.12, 0.1, 0.05), never), (box(0.6, 0.1, 0.05), never), (box(0.1, 0.1, 0.15), never), (box(0.6, 0.1, 0.05), late), (box(0.6, 0.1, 0.01), late))]
    assert got == [True, False, False, True, False]
    assert [value(spark, gates.moving_reach(F.lit(g), 30)) for g in (0, 15, 30, 31)] == [1.5, 3.0, 4.5, 1.5]


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert [v(scalars.clock(F.lit(s))) for s in (0.0, 59.9, 61.0, 3600.0, 36061.5)] == ["00:00", "00:59", "01:01", "1:00:00", "10:01:01"]
    assert [v(scalars.is_newer(F.lit(a), F.lit(b))) for a, b in (("v1.2.10", "1.2.9"), ("1.2", "1.2.0"), ("1.2.0", "1.2"), ("x", "1"), ("0.1.20-rc", "0.1.19"))] == [True, False, True, False, True]
    assert [v(scalars.boost_mode(F.lit(x).cast("string"))) for x in (None, "true", "Off", "auto", "bright")] == ["off", "always", "off", "auto", "auto"]
    assert [v(scalars.option_kind(F.lit(x))) for x in ("True", "-3", "0.5", "1e3", "fast", "")] == ["bool", "int", "float", "float", "str", "str"]
    assert v(scalars.evenly_spaced(F.lit(10).cast("long"), F.lit(13).cast("long"), 6)) == [10, 11, 12, 13] and v(scalars.evenly_spaced(F.lit(5).cast("long"), F.lit(5).cast("long"), 1)) == [5]
    assert v(scalars.smoothed(F.array(F.lit(1.0), F.lit(2.0)))) == pytest.approx(0.81)
    h = lambda *x: F.array(*[F.lit(y) for y in x])
    assert [round(v(scalars.bhattacharyya(h(*a), h(*b))), 6) for a, b in (((1, 2, 3), (2, 4, 6)), ((1, 0), (0, 1)), ((0, 0), (1, 1)))] == [0.0, 1.0, 1.0]


def test_segments(spark):
    s = spark.createDataFrame([(1, "Thank you.", 0.9), (2, "Thank you.", 0.5), (3, "  ", 0.0), (4, "um", 0.95), (5, "a longer sentence", 0.99), (6, "hey", 0.9)], "k int, text string, no_speech double")
    assert sorted(r.k for r in text.without_fillers(s).collect()) == [2, 5]
    w = spark.sql("select array() as none, ' all of it ' as t").select(text.words_or_whole(F.col("none").cast("array<struct<start_s:double,end_s:double,word:string>>"), F.col("t"), F.lit(1.0), F.lit(2.0)).alias("w")).first().w
    assert [tuple(x) for x in w] == [(1.0, 2.0, "all of it")]


def said(spark, line):
    rows = [(1, k, w, k * 0.5, k * 0.5 + 0.4) for k, w in enumerate(line.split())]
    return spark.createDataFrame(rows, "media_id long, idx long, word string, start_s double, end_s double").withColumn("norm", text.norm_token(F.col("word")))


def test_every_rule_of_personal_data(spark):
    line = ("My name is John Carter and I was born on the third of March 5 nineteen eighty, call five five five one two three four five six seven "
            "or mail bo@example.com or jane at example dot org I live at 12 West Main Street with plate number A B 7 and officer Smith said 12345 today")  # fmt: skip
    got = [(r.kind, r.text, r.score) for r in text.pii_suggestions(said(spark, line)).orderBy("i0").collect()]
    assert got == [
        ("name", "John Carter", 0.8), ("dob", "March 5 nineteen", 0.75), ("phone", "five five five one two three four five six seven", 0.9), ("email", "bo@example.com", 0.9),
        ("email", "jane at example dot org", 0.8), ("address", "12 West Main Street", 0.8), ("plate", "A B 7 and", 0.7), ("name", "Smith", 0.6), ("digits", "12345", 0.4),
    ]
    assert text.pii_suggestions(said(spark, "nothing to see here")).count() == 0
    hits = text.phrase_hits(said(spark, "Yes, michael CARTER! Carter said the the the"), ["Michäel carter", "carter!", "the the"])
    assert sorted((r.idx, r.phrase, r.hit_end_s) for r in hits.collect()) == [(1, "Michäel carter", 1.4), (2, "carter!", 1.4), (3, "carter!", 1.9), (5, "the the", 3.4), (6, "the the", 3.9)]


def test_speed_widens_the_reach(spark):
    box = lambda x, w: Box(*(F.lit(float(v)) for v in (x, 0.1, w, w)))
    got = [value(spark, gates.plausible(box(0.1, 0.1), box(x, w), F.lit(late), gap, speed)) for x, w, late, gap, speed in ((0.35, 0.1, False, 0, 0.0), (0.4, 0.1, False, 10, 0.0), (0.4, 0.1, False, 10, 0.01), (0.4, 0.1, False, 10, 0.02), (0.9, 0.28, True, 500, 0.0), (0.9, 0.0, True, 500, 0.0))]
    assert got == [True, False, True, True, True, False]


def test_boxes_that_stay_believable(spark):
    box = lambda w, h: Box(*(F.lit(float(v)) for v in (0, 0, w, h)))
    got = [value(spark, gates.sane(box(*a), box(100, 50))) for a in ((100, 50), (200, 100), (60, 20), (100, 100), (50, 27))]
    assert got == [True, False, False, False, False]
    region = lambda x, w: tuple(value(spark, gates.search_region(Box(*(F.lit(float(v)) for v in (x, 300, w, w))), 1280, 720)))
    assert region(600, 80) == (480, 180, 800, 500) and region(0, 10) == (0, 177, 256, 433) and region(100, 900) == (0, 0, 1280, 720)


def test_frozen_and_cut(spark):
    rows = [(1, f, 5.0) for f in range(20)] + [(2, f, 5.0 + f % 2) for f in range(20)] + [(3, 0, 1.0)] + [(4, f, 1.0 if f < 12 else 9.0) for f in range(20)]
    got = {r.m: (r.frames, r.frozen) for r in gates.frozen(spark.createDataFrame(rows, "m int, f int, v double"), "m", "f", "v").collect()}
    assert got == {1: (12, True), 2: (12, False), 3: (1, False), 4: (12, True)}
    h = spark.createDataFrame([(1, 0, [4, 0]), (1, 1, [8, 0]), (1, 2, [0, 4]), (1, 3, [1, 3])], "media_id long, frame long, h array<int>")
    assert [r.kind for r in gates.scenes(h, "h").orderBy("frame").collect()] == ["still", "cut", "plain"]
