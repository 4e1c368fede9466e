"""Queries of training rows, tracker output, held spans, timeline hits and the log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import training
from tessera.sources.adapters import DETS, KEYS, SPANS, dets, keys, spans, table

from .registry import query

CLASSES = ["face", "license_plate", "phone"]


@query(f"""WITH d AS ({DETS}), c AS (SELECT DISTINCT media_id, ('0x' || md5(CAST(media_id AS VARCHAR))[1:8])::BIGINT / 4294967296.0::DOUBLE AS place FROM d)
 SELECT det_no, d.media_id, frame, list_position({CLASSES}, label) AS category_id, x * 1280 AS bx, y * 720 AS by, w * 1280 AS bw, h * 720 AS bh, w * 1280 * (h * 720) AS area, CASE WHEN place < 0.15::DOUBLE OR place = (SELECT min(place) FROM c) THEN 'val' ELSE 'train' END AS split
 FROM d JOIN c ON c.media_id = d.media_id WHERE label IN ('face', 'license_plate', 'phone') AND w * 1280 >= 64 AND h * 720 >= 64""")
def training_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of three classes, split by medium."""
    return training.annotations(dets(spark, sf_dir), CLASSES, 1280, 720, 64)


# A tracker that knows as many tracks as there are detections, each a little off.
TRACKED = "SELECT media_id, frame, 1000000000 + det_no AS track_id, x + (det_no % 3) / 64 AS x, y, w, h FROM {d}"


@query()
def tied_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that a tracker's boxes stand for."""
    d = dets(spark, sf_dir)
    return training.tied(spark.sql(TRACKED, d=d), d)


@query(f"""WITH s AS ({SPANS}), p AS (SELECT media_id, track_id, greatest(start_frame - 15, 0) AS start_frame, least(end_frame + 15 + 4, 1000000) AS end_frame FROM s),
 m AS (SELECT *, CASE WHEN start_frame <= 1 + max(end_frame) OVER (PARTITION BY track_id ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
 r AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS run FROM m)
 SELECT media_id, track_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, count(*) AS n_spans FROM r GROUP BY media_id, track_id, run""")
def held_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans held on for fifteen frames and a step of five."""
    return training.held(spans(spark, sf_dir), 15, 5, 1000000)


POINTS = "SELECT event_id, user_id % 8 AS media_id, event_id * 0.5 / 30 AS t FROM events"


@query(f"""WITH s AS ({SPANS}), p AS ({POINTS.replace('0.5', '0.5::DOUBLE')}), r AS (SELECT media_id, track_id, start_frame / 30 AS start_s, (end_frame + 1) / 30 AS end_s FROM s)
 SELECT event_id, track_id, t, start_s, end_s FROM p JOIN r ON r.media_id = p.media_id AND t BETWEEN start_s AND end_s""")
def timeline_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions under the places that were clicked."""
    p = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("media_id"), (F.col("event_id") * 0.5 / 30).alias("t"))
    r = spans(spark, sf_dir).select("media_id", "track_id", (F.col("start_frame") / 30).alias("start_s"), ((F.col("end_frame") + 1) / 30).alias("end_s"))
    return training.hits(p, r).select("event_id", "track_id", "t", "start_s", "end_s")


@query(f"""WITH k AS ({KEYS}), a AS (SELECT DISTINCT media_id, track_id FROM k WHERE frame < 2500), b AS (SELECT DISTINCT media_id, track_id FROM k WHERE frame >= 2500 AND score >= 0.9::DOUBLE)
 SELECT *, 'add_video_track' AS action FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x UNION ALL SELECT *, 'remove_video_track' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y""")
def project_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks added and removed between two states."""
    k = keys(spark, sf_dir)
    return training.logged(k.where("frame < 2500"), k.where("frame >= 2500 and score >= 0.9"), ["media_id", "track_id"], "video_track")


@query("SELECT label, count(*) AS n FROM (SELECT CASE user_id % 80 WHEN 0 THEN 'person' WHEN 2 THEN 'vehicle' WHEN 3 THEN 'vehicle' WHEN 5 THEN 'vehicle' WHEN 7 THEN 'vehicle' WHEN 62 THEN 'screen' WHEN 63 THEN 'screen' WHEN 64 THEN 'mouse' WHEN 66 THEN 'keyboard' WHEN 67 THEN 'phone' WHEN 73 THEN 'document' END AS label FROM events) x GROUP BY label")
def privacy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class numbers as labels; those that do not matter have none."""
    return table(spark, sf_dir, "events").select(training.privacy_label(F.col("user_id") % 80).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
