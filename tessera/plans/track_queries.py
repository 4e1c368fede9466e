"""Queries over tracks: spans, keyframes, edits, flags, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import Box
from tessera.operators import greedy, tracks
from tessera.operators.intervals import interpolate, merge_spans, overlap_join
from tessera.sources.adapters import DETS, KEYS, SPANS, keys, spans, table

from .registry import query

FPS = 30


@query(f"WITH s AS ({SPANS}) SELECT media_id, track_id, label, min(start_frame) AS first_frame, max(end_frame) AS last_frame, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS total_frames, count(*) AS n_spans FROM s GROUP BY media_id, track_id, label")
def track_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.extent(spans(spark, sf_dir))


@query(f"""WITH k AS ({KEYS}), t AS (SELECT media_id, track_id, label, count(*) AS hits, round(avg(score), 6) AS mean_score, quantile_cont(h, 0.5) AS median_h FROM k GROUP BY media_id, track_id, label)
 SELECT *, CASE WHEN label IN ('face', 'head') THEN median_h <= 0.6::DOUBLE AND hits >= 3 AND mean_score >= 0.7::DOUBLE ELSE hits >= 2 AND mean_score >= 0.4::DOUBLE END AS confirmed FROM t""")
def confirmed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.confirm(keys(spark, sf_dir))


@query(f"""WITH s AS ({SPANS}), p AS (SELECT media_id, track_id, greatest(start_frame - 20, 0) AS start_frame, end_frame + 20 AS end_frame FROM s),
 m AS (SELECT *, CASE WHEN start_frame <= 1 + max(end_frame) OVER (PARTITION BY track_id ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
 r AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS run FROM m)
 SELECT media_id, track_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, count(*) AS n_spans FROM r GROUP BY media_id, track_id, run""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans extended by twenty frames on each side, then merged where they overlap or adjoin."""
    s = spans(spark, sf_dir).select("media_id", "track_id", F.greatest(F.col("start_frame") - 20, F.lit(0)).alias("start_frame"), (F.col("end_frame") + 20).alias("end_frame"))
    return merge_spans(s, ["media_id", "track_id"])


EVERY = "(SELECT DISTINCT media_id, frame FROM k)"


@query(f"WITH k AS ({KEYS}), s AS ({SPANS}), f AS {EVERY} SELECT f.media_id, f.frame, s.track_id, s.span_no FROM f JOIN s ON f.media_id = s.media_id AND f.frame BETWEEN s.start_frame AND s.end_frame")
def active_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tracks are on a frame, for every frame of the tables."""
    f = keys(spark, sf_dir).select("media_id", "frame", F.col("frame").alias("frame2")).distinct()
    return overlap_join(f, spans(spark, sf_dir), ["media_id"], 128, ("frame", "frame2"), ("start_frame", "end_frame")).select("media_id", "frame", "track_id", "span_no")


def boxes_sql(frames: str) -> str:
    return f"""WITH k AS ({KEYS}), s AS ({SPANS}), q AS (SELECT DISTINCT s.media_id, s.track_id, f.frame FROM s JOIN {frames} f ON f.media_id = s.media_id AND f.frame BETWEEN s.start_frame AND s.end_frame),
 p AS (SELECT q.*, k.frame AS f0, k.x AS ax, k.y AS ay, k.w AS aw, k.h AS ah FROM q ASOF JOIN k ON q.track_id = k.track_id AND q.frame >= k.frame),
 m AS (SELECT p.*, CASE WHEN k.frame > f0 THEN (p.frame - f0) / (k.frame - f0) ELSE 0.0::DOUBLE END AS t, k.x AS bx, k.y AS by_, k.w AS bw, k.h AS bh FROM p ASOF JOIN k ON p.track_id = k.track_id AND p.frame <= k.frame)
 SELECT media_id, track_id, frame, ax + (bx - ax) * t AS x, ay + (by_ - ay) * t AS y, aw + (bw - aw) * t AS w, ah + (bh - ah) * t AS h FROM m"""


def boxes_at(k: DataFrame, s: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes of a medium's active tracks on its frames (media_id, frame), between their keyframes; unrounded."""
    f = frames.select("media_id", "frame", F.col("frame").alias("frame2")).distinct()
    asked = overlap_join(f, s.select("media_id", "track_id", "start_frame", "end_frame"), ["media_id"], 128, ("frame", "frame2"), ("start_frame", "end_frame")).select("media_id", "track_id", "frame").distinct()
    return interpolate(asked, k, ["media_id", "track_id"])


@query(boxes_sql(EVERY))
def interpolated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the active tracks on every frame of the tables."""
    k = keys(spark, sf_dir)
    return boxes_at(k, spans(spark, sf_dir), k)


@query(f"""WITH s AS ({SPANS}) SELECT a.track_id AS a, b.track_id AS b, CAST(sum(least(a.end_frame, b.end_frame) - greatest(a.start_frame, b.start_frame) + 1) AS BIGINT) AS frames FROM s a JOIN s b
 ON a.media_id = b.media_id AND a.track_id < b.track_id AND a.start_frame <= b.end_frame AND b.start_frame <= a.end_frame GROUP BY a.track_id, b.track_id""")
def covisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in which two tracks of a medium are seen together."""
    return tracks.covisible(spans(spark, sf_dir))


@query(f"""WITH k AS ({KEYS}), s AS ({SPANS}), e AS (SELECT s.*, a.x AS fx, a.y AS fy, a.w AS fw, a.h AS fh, b.x AS lx, b.y AS ly, b.w AS lw, b.h AS lh FROM s JOIN k a ON a.track_id = s.track_id AND a.frame = s.start_frame JOIN k b ON b.track_id = s.track_id AND b.frame = s.end_frame),
 p AS (SELECT *, lag(end_frame) OVER w AS pe, lag(lx) OVER w AS px, lag(ly) OVER w AS py, lag(lw) OVER w AS pw, lag(lh) OVER w AS ph FROM e WINDOW w AS (PARTITION BY track_id ORDER BY start_frame)),
 m AS (SELECT *, CASE WHEN start_frame - pe > 0 AND start_frame - pe <= 150 AND greatest(pw, ph) / greatest(fw, fh) BETWEEN 0.5::DOUBLE AND 2 AND sqrt((px + pw / 2 - fx - fw / 2) * (px + pw / 2 - fx - fw / 2) + (py + ph / 2 - fy - fh / 2) * (py + ph / 2 - fy - fh / 2)) <= greatest(greatest(pw, ph), greatest(fw, fh)) * 1.5::DOUBLE THEN 0 ELSE 1 END AS new FROM p),
 r AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY start_frame ROWS UNBOUNDED PRECEDING) AS run FROM m)
 SELECT media_id, track_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, count(*) AS n_spans FROM r GROUP BY media_id, track_id, run""")
def bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive spans of a track joined over gaps of up to 150 frames where the boxes at the ends are near."""
    return tracks.bridge(spans(spark, sf_dir), keys(spark, sf_dir), 150)


@query()
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a label chained over gaps: each joins the latest-ending chain that it follows closely."""
    return tracks.link_fragments(spans(spark, sf_dir), keys(spark, sf_dir), 30)


@query()
def chunks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks cut into chunks of 400 frames that share 40 with the next, put together again."""
    k = keys(spark, sf_dir)
    first, last = F.floor(F.greatest(F.col("frame") - 40, F.lit(0)) / 400), F.floor(F.col("frame") / 400)
    cut = k.withColumn("chunk", F.explode(F.sequence(first, last)))
    key = F.array_sort(F.collect_list(F.struct("frame", *"xywh")))
    pieces = cut.groupBy("media_id", "label", "chunk", F.col("track_id").alias("piece")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), key.alias("keys"))
    return tracks.merge_chunks(pieces)


@query()
def simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes that a straight line between their neighbours does not give."""
    return tracks.simplify_keys(keys(spark, sf_dir))


@query(f"""WITH k AS ({KEYS}), c AS (SELECT track_id, CAST(floor((min(frame) + max(frame)) / 2) AS BIGINT) AS cut FROM k GROUP BY track_id)
 SELECT k.track_id, CASE WHEN frame < cut THEN 0 ELSE 1 END AS part, count(*) AS n_keys, min(frame) AS first_frame, max(frame) AS last_frame FROM k JOIN c ON k.track_id = c.track_id GROUP BY k.track_id, CASE WHEN frame < cut THEN 0 ELSE 1 END""")
def split_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks cut in two at the middle of their extent."""
    k = keys(spark, sf_dir)
    cut = k.groupBy("track_id").agg(F.floor((F.min("frame") + F.max("frame")) / 2).alias("cut"))
    return tracks.split_at(k.join(cut, "track_id"), F.col("cut")).groupBy("track_id", "part").agg(F.count("*").alias("n_keys"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query(f"""WITH k AS ({KEYS}) SELECT track_id, frame, CASE WHEN frame >= 500 THEN greatest(least(x + w / 2 + 0.125::DOUBLE - w * 1.5::DOUBLE / 2, 1), 0) ELSE x END AS x, CASE WHEN frame >= 500 THEN least(w * 1.5::DOUBLE, 1 - greatest(least(x + w / 2 + 0.125::DOUBLE - w * 1.5::DOUBLE / 2, 1), 0)) ELSE w END AS w FROM k""")
def edited_onward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from frame 500 on moved to the right by an eighth and widened by half about their centres."""
    return tracks.apply_edit(keys(spark, sf_dir), 500, "onward", dx=0.125, dy=0.0, sw=1.5, sh=1.0).select("track_id", "frame", "x", "w")


NOTE = "CASE n_keys % 4 WHEN 0 THEN 'single detection' WHEN 1 THEN 'avg conf 0.55' WHEN 2 THEN 'linked 2 fragments, avg conf 0.71' ELSE 'head-fallback' END"


@query(f"""WITH t AS (SELECT track_id, label, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS frames, sum(n_keys) AS n_keys FROM ({SPANS}) s GROUP BY track_id, label), n AS (SELECT *, {NOTE} AS note FROM t)
 SELECT track_id, concat_ws(',', CASE WHEN frames < {FPS} THEN 'short' END, CASE WHEN contains(note, 'single detection') THEN 'single' END, CASE WHEN TRY_CAST(nullif(regexp_extract(note, 'avg conf ([0-9.]+)', 1), '') AS DOUBLE) < 0.6::DOUBLE THEN 'low-conf' END,
  CASE WHEN label = 'head' OR contains(note, 'head-fallback') THEN 'head-fallback' END, CASE WHEN contains(note, 'linked') OR contains(note, 'merged') THEN 'linked' END) AS flags FROM n""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to look at a track again, from its length, label and note."""
    t = spans(spark, sf_dir).groupBy("track_id", "label").agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"), F.sum("n_keys").alias("n_keys"))
    return t.withColumn("note", F.expr(NOTE)).select("track_id", F.array_join(tracks.flags(F.lit("auto"), F.col("label"), F.col("note"), F.col("frames"), FPS), ",").alias("flags"))


@query(f"""WITH s AS ({SPANS}) SELECT 'video' AS kind, media_id, track_id, label, span_no, round(start_frame / {FPS}, 3) AS start_s, round((end_frame + 1) / {FPS}, 3) AS end_s, coalesce(CASE track_id % 3 WHEN 0 THEN 'blur' WHEN 1 THEN 'blue' END, 'black') AS style FROM s""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track and span; end times are exclusive; a missing style is the default."""
    style = F.when(F.col("track_id") % 3 == 0, "blur").when(F.col("track_id") % 3 == 1, "blue")
    return tracks.report(spans(spark, sf_dir).withColumn("style", style), FPS, "black")


@query(f"""WITH s AS ({SPANS}), m AS (SELECT media_id, string_agg(track_id || ':' || start_frame || '-' || end_frame, ';' ORDER BY track_id, start_frame) AS body FROM s GROUP BY media_id) SELECT media_id, sha256(body) AS digest, length(body) AS n_chars FROM m""")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a medium's spans in a fixed order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_id", "start_frame", "end_frame"))), lambda s: F.concat(s["track_id"], F.lit(":"), s["start_frame"], F.lit("-"), s["end_frame"])), ";")
    m = spans(spark, sf_dir).groupBy("media_id").agg(body.alias("body"))
    return m.select("media_id", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("n_chars"))


@query("""WITH t AS (SELECT user_id % 20 AS media_id, epoch_us(ts) // 1000 AS ms FROM events), d AS (SELECT media_id, ms - lag(ms) OVER (PARTITION BY media_id ORDER BY ms) AS gap FROM t), p AS (SELECT media_id, quantile_cont(gap, 0.5) AS med, count(*) AS n FROM d WHERE gap > 0 GROUP BY media_id)
 SELECT p.media_id, n, med AS median_ms, round(avg(CASE WHEN abs(gap - med) > 0.2::DOUBLE * med THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS irregular, n >= 8 AND avg(CASE WHEN abs(gap - med) > 0.2::DOUBLE * med THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.02::DOUBLE AS vfr FROM d JOIN p ON p.media_id = d.media_id WHERE gap > 0 GROUP BY p.media_id, n, med""")
def vfr_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the frame rate variable: the share of gaps that differ from the median by a fifth."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("media_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    return tracks.variable_rate(e, "media_id", "ms")


@query("""SELECT fps, arg_min(r, (abs(r - fps), r)) AS nearest FROM (SELECT DISTINCT (user_id % 40) * 1.75::DOUBLE + 1 AS fps FROM events) f, (VALUES (23.976::DOUBLE), (24), (25), (29.97), (30), (50), (59.94), (60)) s(r) GROUP BY fps HAVING min(abs(r - fps)) <= 0.08::DOUBLE * fps""")
def nearest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select(((F.col("user_id") % 40) * 1.75 + 1).alias("fps")).distinct()
    return f.withColumn("nearest", g.nearest_rate(F.col("fps"))).where("abs(nearest - fps) <= 0.08 * fps and nearest in (23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0)")


@query(f"""WITH k AS ({KEYS}) SELECT track_id, frame, nxt FROM (SELECT track_id, frame, coalesce(lead(frame) OVER (PARTITION BY track_id ORDER BY frame), first_value(frame) OVER (PARTITION BY track_id ORDER BY frame)) AS nxt FROM k WHERE score < 0.25::DOUBLE) x""")
def next_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next weak keyframe of a track, wrapping at the end."""
    w = W.partitionBy("track_id").orderBy("frame")
    return keys(spark, sf_dir).where("score < 0.25").select("track_id", "frame", F.coalesce(F.lead("frame").over(w), F.first("frame").over(w)).alias("nxt"))


@query(f"""WITH k AS ({KEYS}), g AS (SELECT *, max(CASE WHEN score >= 0.5::DOUBLE THEN frame END) OVER (PARTITION BY track_id) AS good FROM k) SELECT track_id, count(*) AS kept, max(frame) AS last_kept FROM g WHERE frame <= good GROUP BY track_id""")
def trimmed_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes up to the last confirmed one."""
    good = F.max(F.when(F.col("score") >= 0.5, F.col("frame"))).over(W.partitionBy("track_id"))
    return keys(spark, sf_dir).withColumn("good", good).where("frame <= good").groupBy("track_id").agg(F.count("*").alias("kept"), F.max("frame").alias("last_kept"))


@query("SELECT CAST(floor(event_id / 256) AS BIGINT) AS bucket, max(abs(value - 245)) AS peak FROM events GROUP BY floor(event_id / 256)")
def waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 256).alias("bucket")).agg(F.max(F.abs(F.col("value") - 245)).alias("peak"))
