import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import edits
from tessera.sources import files, sinks

B = (0.25, 0.25, 0.25, 0.25)


@pytest.fixture(scope="module")
def track(spark):
    spans = spark.createDataFrame([(1, 7, 0, 0, 10), (1, 7, 1, 20, 30)], "media_id long, track_id long, span_no long, start_frame long, end_frame long")
    keys = spark.createDataFrame([(1, 7, 0, 0.0, 0.0, 0.25, 0.25), (1, 7, 10, 0.5, 0.5, 0.25, 0.25), (1, 7, 20, *B), (1, 7, 30, *B)], "media_id long, track_id long, frame long, x double, y double, w double, h double")
    return edits.nest(spans, keys)


def spans(df):
    return sorted((r.start_frame, r.end_frame, [k.frame for k in r["keys"]]) for r in df.collect())


def test_trims_and_splits(track):
    assert spans(edits.trim_start(track, 5)) == [(5, 10, [5, 10]), (20, 30, [20, 30])]
    assert edits.trim_start(track, 5).where("start_frame = 5").first()["keys"][0].x == 0.25
    assert spans(edits.trim_end(track, 15)) == [(0, 10, [0, 10])]
    cut = edits.split_at(track, 25)
    assert spans(cut.where("part = 0")) == [(0, 10, [0, 10]), (20, 24, [20, 24])]
    assert spans(cut.where("part = 1")) == [(25, 30, [25, 30])]
    assert spans(edits.split_at(track, 15)) == spans(track) == spans(edits.split_at(track, 0))


def test_extends_and_sets_keys(track):
    assert spans(edits.extend_to(track, 12)) == [(0, 12, [0, 10]), (20, 30, [20, 30])]
    assert spans(edits.extend_to(track, 19)) == [(0, 10, [0, 10]), (19, 30, [20, 30])]
    assert spans(edits.extend_to(track, 5)) == spans(track)
    assert spans(edits.set_key(track, 14, B)) == [(0, 14, [0, 10, 14]), (20, 30, [20, 30])]
    assert spans(edits.set_key(track, 25, B)) == [(0, 10, [0, 10]), (20, 30, [20, 25, 30])]
    assert spans(edits.remove_key(track, 20)) == [(0, 10, [0, 10]), (20, 30, [30])]


def test_corrections_by_scope(track):
    count = {s: edits.correct(track, 20, (0.5, 0.25, 0.25, 0.25), s).agg(F.sum("n_changed")).first()[0] for s in ("frame", "onward", "back", "track")}
    assert count == {"frame": 0, "onward": 1, "back": 2, "track": 3}
    after = {r.frame: r.x for r in edits.flatten(edits.correct(track, 20, (0.5, 0.25, 0.25, 0.25), "onward")).collect()}
    assert after == {0: 0.0, 10: 0.5, 20: 0.5, 30: 0.5}


def test_full_picture(spark):
    r = edits.full_picture(spark.createDataFrame([(1, 2, 9, 3)], "media_id long, track_id long, start_frame long, end_frame long")).first()
    assert (r.start_frame, r.end_frame, r["keys"][0].w, r.pad) == (3, 9, 1.0, 0.0)


def test_label_files(spark, tmp_path):
    (tmp_path / "clip").mkdir()
    (tmp_path / "clip" / "clip_f000003.txt").write_text("0 0.5 0.5 0.25 0.25\n\nshort\n9 0.5 0.5 2 0.5\n")
    (tmp_path / "clip" / "clip_f000004.txt").write_text("")
    (tmp_path / "clip" / "classes.txt").write_text("face\n")
    frames, boxes = files.label_files(spark, str(tmp_path), ["face"])
    assert sorted((r.media_id, r.frame) for r in frames.collect()) == [("clip", 3), ("clip", 4)]
    assert sorted((r.cls, r.x, r.y, r.w, r.h) for r in boxes.collect()) == [("9", 0.0, 0.25, 1.0, 0.5), ("face", 0.375, 0.375, 0.25, 0.25)]
    lines = {r.frame: r.text for r in sinks.label_lines(boxes.where("cls = 'face'"), frames, ["face"]).collect()}
    assert lines == {3: "0 0.500000 0.500000 0.250000 0.250000\n", 4: ""}


def test_annotation_exports(spark, tmp_path):
    coco, ls = tmp_path / "coco", tmp_path / "ls"
    coco.mkdir(), ls.mkdir()
    doc = {"categories": [{"id": 1, "name": "face"}], "images": [{"id": 5, "file_name": "a/clip_f000007.jpg", "width": 200, "height": 100}, {"id": 6, "file_name": "odd.jpg", "width": 1, "height": 1}]}
    doc["annotations"] = [{"image_id": 5, "category_id": 1, "bbox": [50, 25, 50, 25]}, {"image_id": 5, "category_id": 2, "bbox": [0, 0, 20, 10]}, {"image_id": 8, "category_id": 1, "bbox": [0, 0, 1, 1]}]
    (coco / "clip.json").write_text(json.dumps(doc))
    frames, boxes = files.coco(spark, str(coco))
    assert [tuple(r) for r in frames.collect()] == [("clip", 7)]
    assert sorted((r.cls, r.x, r.w) for r in boxes.collect()) == [("2", 0.0, 0.1), ("face", 0.25, 0.25)]
    rect = lambda label, x: {"type": "rectanglelabels", "value": {"x": x, "y": 10, "width": 20, "height": 30, "rectanglelabels": [label]}}
    tasks = [
        {"data": {"image": "/d/clip_f000001.jpg"}, "annotations": [{"result": [rect("face", 1)]}, {"result": [rect("phone", 50)]}, {"was_cancelled": True, "result": []}]},
        {"data": {"image": "/d/clip_f000002.jpg"}, "annotations": [{"was_cancelled": True, "result": []}]}, {"data": {"image": "/d/clip_f000003.jpg"}, "annotations": [{"result": []}]},
    ]
    (ls / "export.json").write_text(json.dumps(tasks))
    frames, boxes = files.reviewed(spark, str(ls))
    assert sorted(r.frame for r in frames.collect()) == [1, 3]
    assert [(r.media_id, r.frame, r.cls, r.x) for r in boxes.collect()] == [("clip", 1, "phone", 0.5)]


def test_projects_and_saved_tracks(spark, track, tmp_path):
    doc = sinks.track_documents(track.withColumn("label", F.lit("face"))).first().document
    (tmp_path / "p").mkdir(), (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.json").write_text(doc)
    (tmp_path / "p" / "a.proj").write_text(json.dumps({"format": "some-project", "version": 1, "video_tracks": json.loads(doc)}))
    (tmp_path / "p" / "b.proj").write_text("{}")
    assert spans(files.saved_tracks(spark, str(tmp_path / "t"))) == spans(track)
    parsed = files.projects(spark, str(tmp_path / "p"), "some-project")
    assert sorted(r.error or "" for r in parsed.collect()) == ["", "not a project file"]
    got = files.project_spans(parsed)
    assert spans(got) == spans(track) and {(r.label, r.pad, r.enabled) for r in got.collect()} == {("face", 0.1, True)}


def test_media_tags_and_kinds(spark):
    text = "Input #0, mov, from 'a.mp4':\n  Metadata:\n    encoder         : Lavf58\n    location        : +1:2/\n  Duration: 00:00:01\n  Stream #0:1(und): Audio\n    Metadata:\n      handler_name    : Sound\nOut: x"
    got = {(r.section, r.key): r.value for r in files.tags(spark.createDataFrame([("a", text), ("b", None)], "path string, text string")).collect()}
    assert got == {("format", "encoder"): "Lavf58", ("format", "location"): "+1:2/", ("stream1", "handler_name"): "Sound"}
    kinds = spark.createDataFrame([("a/B.MP4",), ("x.wav",), ("x.txt",), ("x",)], "path string").select(files.media_kind(F.col("path")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["video", "audio", None, None]


def test_settings(spark):
    base = {"language": "en", "video_pad": 0.4, "detect_head": False, "other": [1]}
    rows = [("old", '{"language": "", "video_pad": 0.1, "detect_head": true, "last_box_style": "pixelate"}'), ("chosen", '{"settings_rev": 3, "video_pad": 0.2, "detect_head": true}'), ("moved", '{"settings_rev": 3, "video_pad": 0.1}'), ("none", None), ("broken", "{")]
    got = {r.name: {k: json.loads(v) for k, v in r.settings.items()} for r in files.settings(spark.createDataFrame(rows, "name string, text string"), base).collect()}
    assert got["old"] == {"language": "en", "video_pad": 0.4, "detect_head": False, "other": [1], "last_box_style": None, "detect_precise": True, "settings_rev": 4}
    assert (got["chosen"]["video_pad"], got["chosen"]["detect_head"], got["moved"]["video_pad"]) == (0.2, True, 0.4)
    assert got["none"] == got["broken"] == base | {"detect_precise": True, "settings_rev": 4}


def test_tasks_and_seals(spark):
    frames = spark.createDataFrame([("m", 1, "m/1.jpg", 200, 100), ("m", 2, "m/2.jpg", 200, 100)], "media_id string, frame long, image string, width int, height int")
    dets = spark.createDataFrame([("m", 1, "face", 0.5, *B), ("m", 1, "phone", 0.75, *B)], "media_id string, frame long, label string, score double, x double, y double, w double, h double")
    got = {r.image: json.loads(r.task) for r in sinks.annotation_tasks(frames, dets, "v1", "/root/").collect()}
    assert [x["value"]["rectanglelabels"] for x in got["m/1.jpg"]["predictions"][0]["result"]] == [["phone"], ["face"]]
    assert got["m/2.jpg"]["predictions"][0]["result"] == [] and got["m/2.jpg"]["data"]["image"] == "/root/m/2.jpg"
    df = sinks.sealed(spark.createDataFrame([("a", None), ("b", 2)], "path string, n int"), ["path", "n"])
    assert [r.intact for r in sinks.verified(df, ["n", "path"]).collect()] == [True, True]
    assert [r.intact for r in sinks.verified(df.withColumn("n", F.lit(3)), ["path", "n"]).collect()] == [False, False]
