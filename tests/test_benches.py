"""Bench operators and rules on whole tracks, on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import benches

DET = "media_id long, frame long, det_no long, label string, source string, side string, truth boolean, x double, y double, w double, h double"


def boxes(spark, rows):
    return spark.createDataFrame([(0, f, n, "face", s, s, t, x, 0.1, 0.2, 0.2) for n, (f, s, t, x) in enumerate(rows)], DET)


def test_compared_counts_what_was_gained_and_lost(spark):
    d = boxes(spark, [(0, "a", False, 0.1), (0, "b", False, 0.11), (0, "a", False, 0.6), (1, "b", False, 0.3)])
    (r,) = benches.compared(d).collect()
    assert (r["both"], r["gained"], r["lost"]) == (1, 1, 1)


def test_consensus_needs_distinct_sources(spark):
    d = boxes(spark, [(0, "m", False, 0.1), (0, "n", False, 0.11), (0, "m", False, 0.6), (0, "m", False, 0.61)])
    (r,) = benches.consensus(d).collect()
    assert (r["det_no"], r["n_sources"]) == (0, 2)


def test_source_scores_count_frames_without_predictions(spark):
    d = boxes(spark, [(0, "t", True, 0.1), (0, "m", False, 0.1), (0, "m", False, 0.6), (1, "t", True, 0.5)])
    (r,) = benches.source_scores(d).collect()
    assert (r["source"], r["tp"], r["fp"], r["fn"]) == ("m", 1, 1, 1)


def test_same_person_actions(spark):
    t = spark.createDataFrame([(0, 1, "face", True), (0, 2, "face", False), (0, 3, "face", True), (0, 4, "car", True)], "media_id long, track_id long, label string, enabled boolean")
    m = t.where("track_id = 2")
    state = lambda action: {r["track_id"]: r["enabled"] for r in benches.same_person(t, m, 1, action).collect()}
    assert state("only") == {1: True, 2: True, 3: False, 4: True}
    assert state("disable") == {1: True, 2: False, 3: True, 4: True}
    assert state("delete") == {1: True, 3: True, 4: True}
    with pytest.raises(ValueError):
        benches.same_person(t, m, 1, "forget")


def test_retired_styles_turn_black_and_are_logged(spark):
    t = spark.createDataFrame([(0, 1, "face", "pixelate"), (0, 2, "car", "blur"), (0, 3, "car", None)], "media_id long, track_id long, label string, style string")
    new, log = benches.retire_styles(t)
    assert {r["track_id"]: r["style"] for r in new.collect()} == {1: "black", 2: "blur", 3: None}
    assert [(r["media_id"], r["details"]) for r in log.collect()] == [(0, "face 1 pixelate")]


def test_empty_tables(spark):
    d = boxes(spark, [(0, "m", False, 0.1)]).where(F.lit(False))
    assert benches.compared(d).count() == benches.consensus(d).count() == benches.source_scores(d).count() == 0
