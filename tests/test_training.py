"""Training rows, tracker output and the log on hand-made rows."""

from pyspark.sql import functions as F

from tessera.operators import training

BOX = "det_no long, media_id long, frame long, label string, x double, y double, w double, h double"


def test_a_clip_is_on_one_side(spark):
    clips = spark.range(400).select(F.concat(F.lit("clip"), "id").alias("c"))
    got = {r.c: r.split for r in training.split_clips(clips.unionByName(clips), "c").collect()}
    val = sum(v == "val" for v in got.values())
    assert len(got) == 400 and 30 < val < 95
    again = {r.c: r.split for r in training.split_clips(clips.repartition(7), "c").collect()}
    assert again == got
    assert [r.split for r in training.split_clips(clips.limit(1), "c").collect()] == ["val"]
    assert training.split_clips(clips.where("false"), "c").count() == 0


def test_training_rows(spark):
    d = spark.createDataFrame([(1, 1, 0, "car", 0.1, 0.2, 0.5, 0.5), (2, 1, 0, "face", 0.1, 0.2, 0.01, 0.5), (3, 1, 0, "dog", 0.1, 0.2, 0.5, 0.5)], BOX)
    (r,) = training.annotations(d, ["face", "car"], 100, 100, 10).collect()
    assert (r.det_no, r.category_id, r.bx, r.by, r.bw, r.bh, r.area, r.split) == (1, 2, 10.0, 20.0, 50.0, 50.0, 2500.0, "val")
    assert [x.v for x in spark.createDataFrame([(0,), (67,), (1,), (None,)], "k int").select(training.privacy_label(F.col("k")).alias("v")).collect()] == ["person", "phone", None, None]


def test_a_detection_is_tied_to_one_track(spark):
    d = spark.createDataFrame([(1, 1, 0, "a", 0.1, 0.1, 0.2, 0.2), (2, 1, 0, "a", 0.5, 0.5, 0.2, 0.2), (3, 1, 1, "a", 0.1, 0.1, 0.2, 0.2)], BOX)
    t = spark.createDataFrame([(1, 0, 10, 0.12, 0.1, 0.2, 0.2), (1, 0, 11, 0.1, 0.1, 0.2, 0.2), (1, 0, 12, 0.5, 0.5, 0.2, 0.2), (1, 2, 13, 0.1, 0.1, 0.2, 0.2)], "media_id long, frame long, track_id long, x double, y double, w double, h double")
    assert sorted((r.track_id, r.det_no) for r in training.tied(t, d).collect()) == [(10, 1), (12, 2)]


def test_held_hit_and_logged(spark):
    s = spark.createDataFrame([(1, 1, 10, 20), (1, 1, 30, 40), (1, 1, 90, 99)], "media_id long, track_id long, start_frame long, end_frame long")
    assert sorted((r.start_frame, r.end_frame) for r in training.held(s, 5, 3, 100).collect()) == [(5, 47), (85, 100)]
    p = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.5), (2, 1.5)], "media_id long, t double")
    r = spark.createDataFrame([(1, 1.0, 2.0, "a")], "media_id long, start_s double, end_s double, name string")
    assert sorted(x.t for x in training.hits(p, r).collect()) == [1.0, 2.0]
    before, after = (spark.createDataFrame([(v,) for v in k], "id long") for k in ([1, 2, 2], [2, 3]))
    assert sorted((x.id, x.action) for x in training.logged(before, after, ["id"], "track").collect()) == [(1, "remove_track"), (3, "add_track")]
