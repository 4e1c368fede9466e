"""Transcripts of project documents, model files, banners and batches on hand-made rows."""

import json

from pyspark.sql import functions as F

from tessera.sources import files, inventory


def test_words_of_a_project(spark):
    doc = {"format": "p", "transcript": [
        {"start": 0, "end": 2, "text": " hello there ", "words": []},
        {"start": 2, "end": 3, "text": "a b", "words": [{"start": 2, "end": 2.5, "text": "a"}, {"start": 2.5, "end": 3, "text": "b", "confidence": 0.25}]},
        {"start": 4, "end": 5, "text": "tail"},
    ]}
    texts = spark.createDataFrame([("x", json.dumps(doc)), ("y", json.dumps({"format": "p"})), ("z", "{")], "path string, text string")
    parsed = files.parsed_projects(texts, "p")
    assert {r.path: r.error for r in parsed.collect()} == {"x": None, "y": None, "z": "not a project file"}
    got = sorted(files.project_words(parsed).collect(), key=lambda r: r.idx)
    assert [(r.idx, r.segment, r.word, r.confidence) for r in got] == [(0, 0, "hello there", 1.0), (1, 1, "a", 1.0), (2, 1, "b", 0.25), (3, 2, "tail", 1.0)]


def test_the_first_folder_with_a_file_counts(spark):
    registry = spark.createDataFrame([("a", "a.onnx", "h1", False, 10), ("b", "b.onnx", "", False, 0), ("c", "c.onnx", "h3", True, 0), ("d", "d.onnx", None, False, 0), ("e", "e.onnx", "h5", False, 9)], "name string, filename string, sha256 string, optional boolean, min_bytes long")
    found = spark.createDataFrame([(2, "late", "a.onnx", 50, "h1"), (1, "soon", "a.onnx", 20, "h2"), (1, "soon", "b.onnx", 5, "hx"), (1, "soon", "e.onnx", 5, "h5")], "place int, directory string, filename string, bytes long, sha256 string")
    got = {r.name: (r.directory, r.matches_registry) for r in inventory.installed(registry, found).collect()}
    assert got == {"a": ("soon", False), "b": ("soon", None), "e": ("soon", True)}
    assert {r.name: r.fault for r in inventory.model_faults(registry, found).collect()} == {"a": "differs", "d": "missing", "e": "short"}


def test_banners(spark):
    one = "Duration: 01:02:03.5, start\r\n  Stream #0:0: Video: hevc (Main), yuv420p, 1920x1080, 25 fps\r\n  Stream #0:1: Audio: pcm_s16le, 48000 Hz, 1 channels, s16"
    rows = [(0, one), (1, "no banner"), (2, None), (3, "  Stream #0:0: Audio: mp3, 44100 Hz, mono, fltp\n  Stream #0:1: Video: png, rgb24, 500x500 (attached pic)")]
    got = {r.k: r for r in spark.createDataFrame(rows, "k int, b string").select("k", inventory.probed(F.col("b")).alias("p")).select("k", "p.*").collect()}
    assert tuple(got[0])[1:] == (3723.5, "hevc", 1920, 1080, 25.0, "pcm_s16le", 48000, 1)
    assert tuple(got[1])[1:] == tuple(got[2])[1:] == (None,) * 8
    assert (got[3].video_codec, got[3].audio_codec, got[3].channels) == (None, "mp3", 1)
    assert [r.n for r in spark.createDataFrame([(0, 10.0, 25.0), (7, 10.0, 25.0)], "c long, d double, f double").select(inventory.frame_total(F.col("c"), F.col("d"), F.col("f")).alias("n")).collect()] == [250, 7]
