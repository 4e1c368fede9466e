"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from tessera.operators import greedy
from tessera.streaming.association import associate_stream, windowed_counts

SCHEMA = "media_id long, frame long, det_no long, label string, score double, x double, y double, w double, h double"


def rows():
    for f in range(12):
        for k in range(3):
            if (f + k) % 4:
                yield (0, f, f * 3 + k, "face", 0.4 + 0.2 * k, 0.1 + 0.25 * k + 0.01 * f, 0.2, 0.2, 0.2)


def test_tracks_live_across_batches(spark, tmp_path):
    data = list(rows())
    for part in range(4):
        spark.createDataFrame([r for r in data if r[1] // 3 == part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = associate_stream(stream).writeStream.format("memory").queryName("tracks_live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["det_no"]: r["track_no"] for r in spark.table("tracks_live").collect()}
    want = greedy.associate([(r[1], *r[4:]) for r in data])
    assert got == {r[2]: n for r, n in zip(data, want, strict=True)}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    at = lambda h: F.timestamp_seconds(F.lit(1_700_000_000 // 3600 * 3600 + h * 3600))
    for h in (0, 1, 6):
        spark.range(h + 1).select(at(h).alias("ts"), F.lit("a").alias("event_type")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("closed").collect()) == [1, 2]
