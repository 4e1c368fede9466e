"""Reports and case figures on hand-made rows."""

import pytest

from tessera.operators import cases

BOX = "media_id long, frame long, label string, x double, y double, w double, h double"


def test_report_of_both_sides(spark):
    truth = spark.createDataFrame([(1, 0, "face", 0.0, 0.0, 0.2, 0.2), (1, 1, "face", 0.5, 0.5, 0.2, 0.2), (1, 1, "car", 0.0, 0.0, 0.1, 0.1)], BOX)
    red = spark.createDataFrame([(1, 0, "face", 0.0, 0.0, 0.25, 0.25), (1, 2, "head", 0.0, 0.0, 0.2, 0.2)], BOX)
    frames = spark.createDataFrame([(1, f) for f in range(4)], "media_id long, frame long")
    got = {r.label: r for r in cases.accuracy_report(truth, red, frames).collect()}
    assert (got["face"].gt, got["face"].safe, got["face"].recall, got["face"].precision, got["face"].leak_frames) == (2, 1, 0.5, 1.0, 1)
    assert (got["head"].gt, got["head"].recall, got["head"].pred, got["head"].precision) == (0, None, 1, 0.0)
    assert (got["all"].gt, got["all"].safe, got["all"].pred, got["all"].on, got["all"].leak_frames, got["all"].leak_rate) == (3, 1, 2, 1, 1, 0.25)
    assert [r.label for r in cases.accuracy_report(truth.where("false"), red.where("false"), frames).collect()] in ([], ["all"])


def test_overrun_of_a_case(spark):
    case = spark.createDataFrame([(1, 7, "face", 100, 199), (2, 7, "face", 0, 9)], "case_id long, media_id long, label string, start_frame long, end_frame long")
    spans = spark.createDataFrame([(1, 88, 120), (1, 110, 149), (1, 190, 214), (1, 300, 300)], "case_id long, start_frame long, end_frame long")
    keys = spark.createDataFrame([(1, 88, 0.1, 0.1, 0.2, 0.2), (1, 300, 0.1, 0.1, 0.2, 0.2)], "case_id long, frame long, x double, y double, w double, h double")
    # Overrun: 88..99 (12), 200..214 (15), 300 (1); every tenth: 88, 98, 208 (index 20).
    dets = spark.createDataFrame([(7, 98, "face", 0.1, 0.1, 0.2, 0.2), (7, 88, "car", 0.1, 0.1, 0.2, 0.2)], BOX)
    got = {r.case_id: r for r in cases.case_metrics(case, spans, keys, dets).collect()}
    a = got[1]
    assert (a.frames, a.covered, a.coverage, a.tracked, a.spans, a.overrun, a.checked, a.unsupported) == (100, 60, 0.6, 88, 3, 28, 3, 2)
    b = got[2]
    assert (b.covered, b.tracked, b.spans, b.overrun, b.checked) == (0, 0, 0, 0, 0)
    (s,) = cases.summary(cases.case_metrics(case, spans, keys, dets)).collect()
    assert (s.cases, s.coverage, s.full, s.overrun) == (2, round(60 / 110, 3), 0, 28)


def test_time_that_no_stage_took(spark):
    stages = spark.createDataFrame([(1, "decode", 2.0), (1, "decode", 1.0), (1, "detect", 5.0), (2, "detect", 9.0)], "media_id long, stage string, seconds double")
    clips = spark.createDataFrame([(1, 300, 10.0), (2, 100, 8.0), (3, 5, 0.0)], "media_id long, frames long, seconds double")
    got = {(r.media_id, r.stage): r for r in cases.timing(stages, clips).collect()}
    assert got[1, "other"].seconds == pytest.approx(2.0) and got[1, "decode"].share == 0.3 and got[1, "detect"].fps == 30.0
    assert got[2, "other"].seconds == 0.0 and got[3, "other"].fps is None
