"""Queries of the accuracy benches, of redactions still open, and of rules on whole tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import benches
from tessera.sources.adapters import DETS, DOC_WORDS, KEYS, SPANS, WORDS, dets, doc_words, keys, spans, table, words

from .detection_queries import COVERAGE, coverage, iou_sql
from .registry import query
from .transcript_queries import DIGIT_SQL, RANGE_SQL, muted

FPS = 30
RANGES = "ranges AS (SELECT media_id, style, min(start_s) AS start_s, max(end_s) AS end_s FROM runs GROUP BY media_id, style, run)"
HIDDEN = "EXISTS (SELECT 1 FROM ranges r WHERE r.media_id = w.media_id AND (w.start_s + w.end_s) / 2 >= r.start_s AND (w.start_s + w.end_s) / 2 < r.end_s)"


@query(f"""WITH k AS ({KEYS}), s AS ({SPANS}), j AS (SELECT s.*, k.frame AS mid, k.h AS h, row_number() OVER (PARTITION BY s.track_id, s.span_no ORDER BY k.frame) AS rn FROM s JOIN k ON k.track_id = s.track_id AND k.frame BETWEEN s.start_frame AND s.end_frame WHERE s.end_frame - s.start_frame + 1 >= 60),
 r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY h, track_id, span_no) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM j WHERE rn = n_keys // 2 + 1)
 SELECT media_id, track_id, span_no, start_frame, end_frame, mid, h FROM r WHERE n <= 12 OR i IN (SELECT floor(m * n / 12) FROM range(12) t(m))""")
def tracking_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve cases per medium, small boxes to large ones (the number is the feature)."""
    return benches.tracking_cases(spans(spark, sf_dir), keys(spark, sf_dir), 60, 12)


@query(f"""WITH k AS ({KEYS}), s AS ({SPANS}), b AS (SELECT *, CAST(floor((start_frame + end_frame) / 2) AS BIGINT) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY end_frame - start_frame DESC, start_frame) AS rn FROM s) x WHERE rn = 1),
 e AS (SELECT b.media_id, b.track_id, mid, max(k.frame) FILTER (k.frame <= mid) AS f0, min(k.frame) FILTER (k.frame >= mid) AS f1 FROM b JOIN k ON k.track_id = b.track_id GROUP BY b.media_id, b.track_id, mid),
 m AS (SELECT e.*, CASE WHEN f1 > f0 THEN (mid - f0) / (f1 - f0) ELSE 0.0::DOUBLE END AS t, p.x AS ax, p.w AS aw, n.x AS bx, n.w AS bw FROM e JOIN k p ON p.track_id = e.track_id AND p.frame = f0 JOIN k n ON n.track_id = e.track_id AND n.frame = f1)
 SELECT media_id, track_id, mid, round(ax + (bx - ax) * t, 6) AS x, round(aw + (bw - aw) * t, 6) AS w FROM m""")
def retrack_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box to track again from: the middle of each track's longest span."""
    s = benches.retrack_seeds(spans(spark, sf_dir), keys(spark, sf_dir))
    return s.select("media_id", "track_id", "mid", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@query(f"""WITH d AS ({DETS}), k AS ({KEYS}), s AS ({SPANS}), j AS (SELECT d.det_no, s.track_id, s.span_no, k.frame AS key_frame, {iou_sql('d', 'k')} AS v, row_number() OVER (PARTITION BY d.det_no, s.track_id, s.span_no ORDER BY abs(k.frame - d.frame), k.frame) AS rn
 FROM d JOIN s ON s.media_id = d.media_id AND d.frame BETWEEN s.start_frame AND s.end_frame JOIN k ON k.track_id = s.track_id AND k.frame BETWEEN s.start_frame AND s.end_frame) SELECT det_no, track_id, span_no, key_frame FROM j WHERE rn = 1 AND v >= 0.3::DOUBLE""")
def near_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that the nearest keyframe of a span on their frame overlaps."""
    return benches.near_key_match(dets(spark, sf_dir), spans(spark, sf_dir), keys(spark, sf_dir))


@query(f"""WITH f AS (SELECT media_id, frame, count(*) AS n FROM ({DETS}) d GROUP BY media_id, frame), k AS (SELECT media_id, unnest(range(CAST(floor(max(frame) / 30 / 0.25::DOUBLE) AS BIGINT) + 1)) AS k FROM f GROUP BY media_id),
 a AS (SELECT media_id, k, CAST(round_even(k * 0.25::DOUBLE * 30, 0) AS BIGINT) AS frame_a, CAST(round_even((k * 0.25::DOUBLE + 0.5::DOUBLE) * 25, 0) AS BIGINT) AS frame_b FROM k)
 SELECT a.media_id, a.k, frame_a, frame_b, p.n AS n_a, q.n AS n_b FROM a JOIN f p ON p.media_id = a.media_id AND p.frame = frame_a JOIN f q ON q.media_id = a.media_id AND q.frame = frame_b""")
def aligned_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two streams at the same instants, 30 and 25 frames a second, half a second apart."""
    n = dets(spark, sf_dir).groupBy("media_id", "frame").agg(F.count("*").alias("n"))
    return benches.aligned(n, n, 0.25, 30, 25, 0.5)


@query(f"""WITH d AS ({DETS}), a AS (SELECT media_id, frame, sum(score) AS v FROM d GROUP BY media_id, frame), b AS (SELECT media_id, frame, sum(score + x) AS v FROM d GROUP BY media_id, frame),
 t AS (SELECT a.media_id, k, sum(abs(a.v - b.v)) AS off FROM a, range(-10, 11) r(k), b WHERE b.media_id = a.media_id AND b.frame = a.frame + k GROUP BY a.media_id, k)
 SELECT media_id, CAST(k AS INTEGER) AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY off, k) AS rn FROM t) x WHERE rn = 1""")
def stream_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift in frames at which one signal differs least from another."""
    d = dets(spark, sf_dir)
    return benches.best_offset(d.groupBy("media_id", "frame").agg(F.sum("score").alias("v")), d.groupBy("media_id", "frame").agg(F.sum(F.col("score") + F.col("x")).alias("v")))


@query()
def detectors_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benches.compared(dets(spark, sf_dir).withColumn("side", F.when(F.col("det_no") % 2 == 0, "a").otherwise("b")))


@query()
def consensus_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benches.consensus(dets(spark, sf_dir))


@query()
def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benches.source_scores(dets(spark, sf_dir).withColumn("truth", F.col("score") >= 0.5))


SEL = "(SELECT media_id, min(track_id) AS track_id FROM s GROUP BY media_id)"


@query(f"""WITH d AS ({DETS}), k AS ({KEYS}), s AS ({SPANS}), e AS (SELECT s.*, greatest(a.w, a.h) AS first, greatest(b.w, b.h) AS last FROM s JOIN k a ON a.track_id = s.track_id AND a.frame = s.start_frame JOIN k b ON b.track_id = s.track_id AND b.frame = s.end_frame),
 j AS (SELECT d.det_no, e.track_id, greatest(d.w, d.h) AS size, CASE WHEN e.end_frame < d.frame THEN d.frame - e.end_frame WHEN e.start_frame > d.frame THEN e.start_frame - d.frame ELSE 0 END AS gap, CASE WHEN e.end_frame < d.frame THEN last ELSE first END AS other, e.start_frame AS began
  FROM d JOIN {SEL} t ON t.media_id = d.media_id JOIN e ON e.track_id = t.track_id), r AS (SELECT *, row_number() OVER (PARTITION BY det_no ORDER BY gap, began) AS rn FROM j)
 SELECT det_no, track_id, gap FROM r WHERE rn = 1 AND gap > 0 AND gap <= {benches.JOIN_GAP_S}::DOUBLE * {FPS} AND size <= 3 * other AND other <= 3 * size""")
def join_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections taken as drawn boxes, with their medium's first track selected."""
    s = spans(spark, sf_dir)
    drawn = dets(spark, sf_dir).join(s.groupBy("media_id").agg(F.min("track_id").alias("track_id")), "media_id")
    return benches.join_targets(drawn, s, keys(spark, sf_dir), FPS)


ALL_OF = ("the", "in the")


@query(f"""{RANGE_SQL}, {RANGES}, h AS (SELECT media_id, idx AS i0, CASE WHEN phrase = 'the' THEN idx ELSE idx + 1 END AS i1, phrase FROM hits JOIN (SELECT unnest({list(ALL_OF)}) AS phrase) p ON phrase = norm OR phrase = norm || ' ' || norm2)
 SELECT media_id, i0, i1, phrase FROM h WHERE EXISTS (SELECT 1 FROM words w WHERE w.media_id = h.media_id AND w.idx BETWEEN i0 AND i1 AND NOT {HIDDEN})""")
def open_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of phrases to redact everywhere, without those that are redacted in full."""
    w = words(spark, sf_dir)
    size = F.size(F.split("phrase", " "))
    hits = text.phrase_hits(w, list(ALL_OF)).select("media_id", F.col("idx").alias("i0"), (F.col("idx") + size - 1).alias("i1"), "phrase")
    return benches.still_open(hits, w, muted(words(spark, sf_dir)))


@query(f"""{RANGE_SQL.replace(WORDS, DOC_WORDS)}, {RANGES}, d AS (SELECT *, CASE WHEN regexp_matches(norm, '^[0-9]+$') THEN norm ELSE CASE norm {DIGIT_SQL.split('ELSE CASE norm ')[1].split(' END END')[0]} END END AS digit FROM words),
 g AS (SELECT *, idx - row_number() OVER (PARTITION BY media_id ORDER BY idx) AS run FROM d WHERE digit IS NOT NULL), h AS (SELECT media_id, min(idx) AS i0, max(idx) AS i1, string_agg(digit, '' ORDER BY idx) AS digits FROM g GROUP BY media_id, run)
 SELECT media_id, i0, i1, digits FROM h WHERE EXISTS (SELECT 1 FROM words w WHERE w.media_id = h.media_id AND w.idx BETWEEN i0 AND i1 AND NOT {HIDDEN})""")
def open_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits that are not redacted in full."""
    w = doc_words(spark, sf_dir)
    return benches.still_open(text.digit_runs(w).select("media_id", "i0", "i1", "digits"), w, muted(w))


@query(f"""{RANGE_SQL}, {RANGES}, a AS (SELECT media_id, min(start_s) AS from_s, max(end_s) AS to_s FROM words WHERE idx % 40 BETWEEN 10 AND 14 GROUP BY media_id, idx // 40)
 SELECT media_id, style, start_s, end_s FROM ranges r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.media_id = r.media_id AND r.end_s > a.from_s AND r.start_s < a.to_s)""")
def unredacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Muted ranges left after five words in every forty were chosen to be heard."""
    heard = words(spark, sf_dir).where("idx % 40 between 10 and 14").groupBy("media_id", F.floor(F.col("idx") / 40).alias("part")).agg(F.min("start_s").alias("from_s"), F.max("end_s").alias("to_s")).drop("part")
    return benches.unredact(muted(words(spark, sf_dir)).drop("n"), heard)


TAGS = "SELECT user_id % 8 AS file, event_type AS section, CASE event_id % 7 WHEN 0 THEN 'encoder' ELSE 'k' || CAST(event_id % 7 AS VARCHAR(9)) END AS key, props AS value, value AS rank FROM events"


@query(f"WITH t AS ({TAGS}), o AS (SELECT * FROM t WHERE rank > 400) SELECT DISTINCT file, section || '.' || key AS tag FROM t WHERE key <> 'encoder' AND length(value) >= 3 AND EXISTS (SELECT 1 FROM o WHERE o.file = t.file AND o.value = t.value)")
def tags_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a source that its output still holds."""
    t = spark.sql(TAGS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return benches.tags_carried(t, t.where("rank > 400"))


@query(f"WITH d AS ({DETS}) SELECT label, count(*) AS n, quantile_cont(h, 0.1) AS p10, quantile_cont(h, 0.5) AS median, quantile_cont(h, 0.9) AS p90 FROM d GROUP BY label")
def box_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and height percentiles by label."""
    return dets(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), *[F.percentile("h", p).alias(c) for p, c in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))])


@query(f"""WITH {COVERAGE}, f AS (SELECT media_id, count(DISTINCT frame) AS frames FROM d GROUP BY media_id),
 c AS (SELECT media_id, label, count(*) AS boxes, round(avg(CASE WHEN covered >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS recall, count(DISTINCT CASE WHEN covered < 0.9::DOUBLE THEN frame END) AS leak FROM share GROUP BY media_id, label)
 SELECT label, CAST(sum(boxes) AS BIGINT) AS boxes, round(sum(round(recall * boxes, 0)) / sum(boxes), 4) AS recall, round(sum(round(round(leak / frames, 4) * frames, 0)) / (SELECT sum(frames) FROM f), 4) AS leak_rate FROM c JOIN f ON f.media_id = c.media_id GROUP BY label""")
def accuracy_over_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media's reports by label put together: rates are turned back into counts, leaks weighted by frames."""
    f = dets(spark, sf_dir).groupBy("media_id").agg(F.countDistinct("frame").alias("frames"))
    c = coverage(spark, sf_dir).groupBy("media_id", "label").agg(F.count("*").alias("boxes"), F.round(F.avg((F.col("covered") >= 0.9).cast("double")), 4).alias("recall"), F.countDistinct(F.when(F.col("covered") < 0.9, F.col("frame"))).alias("leak"))
    everything = f.agg(F.sum("frames").alias("all_frames"))
    by = c.join(f, "media_id").groupBy("label").agg(F.sum("boxes").alias("boxes"), F.sum(F.rint(F.col("recall") * F.col("boxes"))).alias("covered"), F.sum(F.rint(F.round(F.col("leak") / F.col("frames"), 4) * F.col("frames"))).alias("leaks"))
    return by.join(F.broadcast(everything)).select("label", "boxes", F.round(F.col("covered") / F.col("boxes"), 4).alias("recall"), F.round(F.col("leaks") / F.col("all_frames"), 4).alias("leak_rate"))  # one row


STYLED = f"SELECT DISTINCT media_id, track_id, label, CASE track_id % 3 WHEN 0 THEN 'pixelate' WHEN 1 THEN 'blur' END AS style, track_id % 4 <> 0 AS enabled FROM ({SPANS}) s"


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.when(F.col("track_id") % 3 == 0, "pixelate").when(F.col("track_id") % 3 == 1, "blur")
    return spans(spark, sf_dir).select("media_id", "track_id", "label").distinct().withColumn("style", style).withColumn("enabled", F.col("track_id") % 4 != 0)


@query(f"WITH t AS ({STYLED}) SELECT media_id, 'video_style_retired' AS action, string_agg(label || ' ' || track_id || ' ' || style, '; ' ORDER BY track_id) AS details FROM t WHERE style = 'pixelate' GROUP BY media_id")
def retired_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log says of styles that are no longer offered."""
    return benches.retire_styles(styled(spark, sf_dir))[1]


@query(f"WITH t AS ({STYLED}) SELECT media_id, track_id, CASE WHEN label = 'face' AND track_id % 10 = 0 THEN TRUE WHEN label = 'face' AND track_id <> 5 THEN FALSE ELSE enabled END AS enabled FROM t")
def only_this_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks after all faces but those of one person were disabled."""
    t = styled(spark, sf_dir)
    return benches.same_person(t, t.where("label = 'face' and track_id % 10 = 0"), 5, "only").select("media_id", "track_id", "enabled")
