"""Queries of the rules that follow an object from one sighting to the next, and of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.geometry import Box
from tessera.operators import gates
from tessera.sources.adapters import DETS, KEYS, dets, keys, table

from .detection_queries import GROWN, inter, iou_sql
from .registry import query

# Keyframes of a track with the one before, in pixels of 1280 x 720.
STEPS = f"""SELECT media_id, track_id, frame, frame - lag(frame) OVER t AS gap, x * 1280 AS x, y * 720 AS y, w * 1280 AS w, h * 720 AS h, lag(x) OVER t * 1280 AS px, lag(y) OVER t * 720 AS py, lag(w) OVER t * 1280 AS pw, lag(h) OVER t * 720 AS ph FROM ({KEYS}) k WINDOW t AS (PARTITION BY track_id ORDER BY frame)"""


@query(f"""WITH s AS ({STEPS}), r AS (SELECT *, greatest(w, h) / greatest(pw, ph) AS ratio, greatest(pw, ph) AS size, sqrt((px + pw / 2 - (x + w / 2)) * (px + pw / 2 - (x + w / 2)) + (py + ph / 2 - (y + h / 2)) * (py + ph / 2 - (y + h / 2))) AS far FROM s WHERE gap IS NOT NULL)
 SELECT track_id, frame, CASE WHEN gap > 90 THEN ratio BETWEEN 0.35::DOUBLE AND 3 ELSE ratio BETWEEN 0.5::DOUBLE AND 2 AND far <= greatest(2.5::DOUBLE * size, 1.5::DOUBLE * gap + 2 * size) END AS plausible,
  (w * h) / greatest(pw * ph, 1) BETWEEN 0.3::DOUBLE AND 3 AND (w / greatest(h, 1)) / (pw / greatest(ph, 1)) BETWEEN 0.55::DOUBLE AND 1.8::DOUBLE AS sane FROM r""")
def next_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps between keyframes could be the same object, at one and a half pixels a frame."""
    s = spark.sql(STEPS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).where("gap is not null")
    last, new = Box.of("p"), Box.of()
    return s.select("track_id", "frame", gates.plausible(last, new, F.col("gap") > 90, F.col("gap"), 1.5).alias("plausible"), gates.sane(new, last).alias("sane"))


SIDE = "least(CAST(floor(greatest(256, 4 * greatest(w * 1280, h * 720))) AS BIGINT), 1280)"


@query(f"""WITH d AS ({DETS}), s AS (SELECT det_no, (x + w / 2) * 1280 AS cx, (y + h / 2) * 720 AS cy, {SIDE} AS side FROM d), p AS (SELECT *, CAST(floor(greatest(0, least(1280 - side, cx - side / 2))) AS BIGINT) AS x0, CAST(floor(greatest(0, least(720 - side, cy - side / 2))) AS BIGINT) AS y0 FROM s)
 SELECT det_no, x0, y0, least(1280, x0 + side) AS x1, least(720, y0 + side) AS y1 FROM p""")
def search_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to look for each detection's object."""
    px = Box(F.col("x") * 1280, F.col("y") * 720, F.col("w") * 1280, F.col("h") * 720)
    return dets(spark, sf_dir).select("det_no", gates.search_region(px, 1280, 720).alias("r")).select("det_no", "r.*")


VALUES = "SELECT user_id, event_id, CASE WHEN user_id % 4 = 0 THEN user_id + event_id % 7 * 0.005 ELSE value END AS luma FROM events"


@query(f"""WITH v AS ({VALUES.replace('0.005', '0.005::DOUBLE')}), d AS (SELECT user_id, row_number() OVER w AS n, abs(luma - lag(luma) OVER w) AS d FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, count(*) AS frames, count(*) > 1 AND coalesce(max(d), 0) < 0.05::DOUBLE AS frozen FROM d WHERE n <= 12 GROUP BY user_id""")
def frozen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose first twelve frames stay the same."""
    v = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("user_id") % 4 == 0, F.col("user_id") + F.col("event_id") % 7 * 0.005).otherwise(F.col("value")).alias("luma"))
    return gates.frozen(v, "user_id", "event_id", "luma")


BINS = "list_transform(range(4), lambda b: len(list_filter(l, lambda v: v = b)))"


@query(f"""WITH d AS ({DETS}), l AS (SELECT media_id, frame, list(CAST(floor(x * 4) AS INTEGER)) AS l FROM d GROUP BY media_id, frame), h AS (SELECT media_id, frame, {BINS} AS h FROM l), p AS (SELECT *, lag(h) OVER (PARTITION BY media_id ORDER BY frame) AS b FROM h),
 q AS (SELECT media_id, frame, sqrt(greatest(0, 1 - (sqrt(h[1] * b[1]) + sqrt(h[2] * b[2]) + sqrt(h[3] * b[3]) + sqrt(h[4] * b[4])) / sqrt(list_sum(h) * list_sum(b)))) AS distance FROM p WHERE b IS NOT NULL)
 SELECT media_id, frame, round(distance, 6) AS distance, CASE WHEN distance > 0.55::DOUBLE THEN 'cut' WHEN distance < 0.02::DOUBLE THEN 'still' ELSE 'plain' END AS kind FROM q""")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose histogram of places leaves that of the frame before."""
    bins = F.array(*[F.count(F.when(F.floor(F.col("x") * 4) == b, 1)) for b in range(4)])
    return gates.scenes(dets(spark, sf_dir).groupBy("media_id", "frame").agg(bins.alias("h")), "h").withColumn("distance", F.round("distance", 6))


@query(f"""WITH d AS ({DETS}), p AS (SELECT media_id, frame, label, det_no AS id, x, y, w, h FROM d WHERE score < 0.5::DOUBLE), o AS (SELECT * FROM d WHERE score >= 0.5::DOUBLE),
 m AS (SELECT p.id, o.det_no, o.score, {iou_sql('p', 'o')} AS v, sqrt((p.x + p.w / 2 - (o.x + o.w / 2)) * (p.x + p.w / 2 - (o.x + o.w / 2)) + (p.y + p.h / 2 - (o.y + o.h / 2)) * (p.y + p.h / 2 - (o.y + o.h / 2))) / greatest(p.w, p.h) AS far FROM p JOIN o ON o.media_id = p.media_id AND o.frame = p.frame AND o.label = p.label),
 r AS (SELECT id, det_no, CASE WHEN v > 0 THEN v + 1 WHEN far <= 1 THEN 1 - far / (1 + 1e-9::DOUBLE) END * score AS value FROM m) SELECT id, det_no, round(value, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, det_no) AS rn FROM r WHERE value IS NOT NULL) x WHERE rn = 1""")
def snapped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn boxes (those of low score here) with the detection that each means."""
    d = dets(spark, sf_dir)
    drawn = d.where("score < 0.5").select("media_id", "frame", "label", F.col("det_no").alias("id"), *"xywh")
    return gates.snapped(drawn, d.where("score >= 0.5")).select("id", "det_no", F.round("value", 9).alias("value"))


# A keyframe keeps its track live until the next one, for 60 frames at most; hits count up to it.
LIVE = f"SELECT media_id, row_number() OVER t AS hits, frame + 1 AS from_frame, least(frame + 60, coalesce(lead(frame) OVER t, frame + 60)) AS to_frame, x AS t_x, y AS t_y, w AS t_w, h AS t_h FROM ({KEYS}) k WINDOW t AS (PARTITION BY track_id ORDER BY frame)"


@query(f"""WITH d AS ({DETS}), v AS {GROWN}, live AS ({LIVE}), p AS (SELECT *, EXISTS (SELECT 1 FROM v WHERE v.media_id = d.media_id AND v.frame = d.frame AND {inter('v', 'd')} >= 0.6::DOUBLE * (d.w * d.h)) AS gated FROM d WHERE label = 'license_plate')
 SELECT det_no, gated AS on_vehicle FROM p WHERE gated OR EXISTS (SELECT 1 FROM (SELECT media_id, hits, from_frame, to_frame, t_x AS x, t_y AS y, t_w AS w, t_h AS h FROM live) t WHERE t.media_id = p.media_id AND p.frame BETWEEN from_frame AND to_frame AND hits >= 2 AND {iou_sql('p', 't')} >= 0.3::DOUBLE)""")
def plates_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates on a vehicle, and others that go on a track that is live on their frame."""
    d = dets(spark, sf_dir)
    gated = d.join(gates.vehicle_gate(d).select("det_no", "gated"), "det_no")
    live = spark.sql(LIVE.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return gates.ungated_continuations(gated, live).select("det_no", (F.col("gated") == "plate").alias("on_vehicle"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN len(regexp_split_to_array(text, ' ')) ELSE 1 END AS n, CASE WHEN turn % 2 = 0 THEN regexp_split_to_array(text, ' ')[1] ELSE trim(text) END AS first FROM conversations""")
def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each segment gives; every second one has none of its own and gives one."""
    t = table(spark, sf_dir, "conversations")
    own = F.transform(F.split("text", " "), lambda v, k: F.struct((k * 0.5).alias("start_s"), (k * 0.5 + 0.5).alias("end_s"), v.alias("word")))
    w = text.words_or_whole(F.when(F.col("turn") % 2 == 0, own), F.col("text"), F.lit(0.0), F.lit(9.0))
    return t.select("conv_id", "turn", w.alias("w")).select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.col("w")[0]["word"].alias("first"))
