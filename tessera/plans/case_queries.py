"""Queries of accuracy reports, tracked cases, configurations, timing and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cases, tracks
from tessera.sources.adapters import DETS, KEYS, SPANS, dets, keys, spans, table

from .detection_queries import iou_sql
from .registry import query

FPS = 30

# Boxes with a score of half or more are the truth, the others the redactions.
SIDES = f"d AS ({DETS}), truth AS (SELECT * FROM d WHERE score >= 0.5::DOUBLE), red AS (SELECT * FROM d WHERE score < 0.5::DOUBLE)"


def share_sql(name: str, boxes: str, over: str, n: int) -> str:
    return f"""{name}_c AS (SELECT det_no, b.media_id, b.frame, label, x + w * (i + 0.5::DOUBLE) / {n} AS px, y + h * (j + 0.5::DOUBLE) / {n} AS py FROM {boxes} b, range({n}) s(i), range({n}) t(j)),
 {name} AS (SELECT det_no, media_id, frame, label, avg(CASE WHEN EXISTS (SELECT 1 FROM {over} o WHERE o.media_id = c.media_id AND o.frame = c.frame AND px BETWEEN o.x AND o.x + o.w AND py BETWEEN o.y AND o.y + o.h) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS covered FROM {name}_c c GROUP BY det_no, media_id, frame, label)"""


@query(f"""WITH {SIDES}, {share_sql('t', 'truth', 'red', 6)}, {share_sql('r', 'red', 'truth', 6)}, u AS (SELECT label, media_id, frame, 1 AS gt, CAST(covered >= 0.9::DOUBLE AS INT) AS safe, 0 AS pred, 0 AS hit FROM t UNION ALL SELECT label, media_id, frame, 0, 0, 1, CAST(covered >= 0.5::DOUBLE AS INT) FROM r),
 a AS (SELECT coalesce(label, 'all') AS label, CAST(sum(gt) AS BIGINT) AS gt, CAST(sum(safe) AS BIGINT) AS safe, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(hit) AS BIGINT) AS "on", count(DISTINCT CASE WHEN gt = 1 AND safe = 0 THEN media_id * 1000000000 + frame END) AS leak_frames FROM u GROUP BY GROUPING SETS ((label), ()))
 SELECT *, round(CASE WHEN gt > 0 THEN safe / gt END, 6) AS recall, round(CASE WHEN pred > 0 THEN "on" / pred END, 6) AS precision, round(leak_frames / (SELECT count(*) FROM (SELECT DISTINCT media_id, frame FROM d) f), 6) AS leak_rate FROM a""")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and leaks by label and in all."""
    d = dets(spark, sf_dir)
    return cases.accuracy_report(d.where("score >= 0.5"), d.where("score < 0.5"), d)


# A case is a span of 60 frames or more; its tracking left a hole around the middle and ran on at both ends.
CASES = f"SELECT track_id * 1000000 + span_no AS case_id, track_id, media_id, label, start_frame, end_frame, CAST(floor((start_frame + end_frame) / 2) AS BIGINT) AS mid FROM ({SPANS}) s WHERE end_frame - start_frame >= 59"
LABELS = "CASE label WHEN 'head' THEN 'face' ELSE label END"
CASE_SQL = f"""WITH d AS ({DETS}), k AS ({KEYS}), c AS ({CASES}), s AS (SELECT case_id, greatest(start_frame - 20, 0) AS a, mid - 3 AS b FROM c UNION ALL SELECT case_id, mid + 4 AS a, end_frame + 35 AS b FROM c),
 f AS (SELECT c.case_id, c.track_id, c.media_id, {LABELS} AS label, c.start_frame, c.end_frame, s.frame FROM c JOIN (SELECT case_id, unnest(range(a, b + 1)) AS frame FROM s) s ON s.case_id = c.case_id),
 o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY frame) - 1 AS i FROM f WHERE frame < start_frame OR frame > end_frame),
 p AS (SELECT o.*, k.x, k.y, k.w, k.h FROM o JOIN k ON k.track_id = o.track_id AND k.frame = CASE WHEN o.frame < o.start_frame THEN o.start_frame ELSE o.end_frame END WHERE i % 10 = 0),
 q AS (SELECT case_id, count(*) AS checked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM d WHERE d.media_id = p.media_id AND d.frame = p.frame AND d.label = p.label AND {iou_sql('p', 'd')} >= 0.3::DOUBLE)) AS unsupported FROM p GROUP BY case_id),
 m AS (SELECT case_id, media_id, label, end_frame - start_frame + 1 AS frames, count(*) FILTER (frame BETWEEN start_frame AND end_frame) AS covered, count(*) AS tracked FROM f GROUP BY case_id, media_id, label, start_frame, end_frame),
 r AS (SELECT m.*, round(covered / frames, 3) AS coverage, CAST(2 AS BIGINT) AS spans, tracked - covered AS overrun, coalesce(checked, 0) AS checked, coalesce(unsupported, 0) AS unsupported FROM m LEFT JOIN q ON q.case_id = m.case_id)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = spans(spark, sf_dir), keys(spark, sf_dir)
    ident = (F.col("track_id") * 1000000 + F.col("span_no")).cast("long").alias("case_id")
    c = s.where("end_frame - start_frame >= 59").select(ident, "track_id", "span_no", "media_id", "label", "start_frame", "end_frame", F.floor((F.col("start_frame") + F.col("end_frame")) / 2).alias("mid"))
    parts = F.array(F.struct(F.greatest(F.col("start_frame") - 20, F.lit(0)).alias("start_frame"), (F.col("mid") - 3).alias("end_frame")), F.struct((F.col("mid") + 4).alias("start_frame"), (F.col("end_frame") + 35).alias("end_frame")))
    tracked = c.select("case_id", F.explode(parts).alias("p")).select("case_id", "p.*")
    own = k.join(c.select("case_id", "track_id", "start_frame", "end_frame"), "track_id").where(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).select("case_id", "frame", *"xywh")
    return cases.case_metrics(c.withColumn("label", F.expr(LABELS)), tracked, own, dets(spark, sf_dir))


@query(f"{CASE_SQL} SELECT * FROM r")
def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tracking of each long span went."""
    return _metrics(spark, sf_dir)


@query(f"""{CASE_SQL} SELECT label, count(*) AS cases, round(sum(covered) / sum(frames), 3) AS coverage, count(*) FILTER (coverage >= 0.9::DOUBLE) AS "full", CAST(sum(spans) AS BIGINT) AS spans, CAST(sum(overrun) AS BIGINT) AS overrun, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(unsupported) AS BIGINT) AS unsupported FROM r GROUP BY label""")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.summary(_metrics(spark, sf_dir))


# Three configurations see the boxes of low score from another threshold on.
CONFIGS = ((0, 0.0), (1, 0.125), (2, 0.25))


@query(f"""WITH {SIDES}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v}::DOUBLE)' for i, v in CONFIGS)}) v(config, least)),
 p AS (SELECT det_no, t.media_id, t.frame, config, least, x + w * (i + 0.5::DOUBLE) / 6 AS px, y + h * (j + 0.5::DOUBLE) / 6 AS py FROM truth t, c, range(6) a(i), range(6) b(j)),
 s AS (SELECT config, det_no, avg(CASE WHEN EXISTS (SELECT 1 FROM red r WHERE r.score >= p.least AND r.media_id = p.media_id AND r.frame = p.frame AND px BETWEEN r.x AND r.x + r.w AND py BETWEEN r.y AND r.y + r.h) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS covered FROM p GROUP BY config, det_no),
 e AS (SELECT config, track_id, label, sum(end_frame - start_frame + 1) AS n FROM ({SPANS}) x, c WHERE track_id % 3 >= config GROUP BY config, track_id, label)
 SELECT config, count(*) AS reference_boxes, count(*) FILTER (covered >= 0.6::DOUBLE) AS covered, round(count(*) FILTER (covered >= 0.6::DOUBLE) / count(*), 6) AS share, (SELECT count(*) FROM e WHERE e.config = s.config AND label = 'head') AS heads, (SELECT CAST(sum(n) AS BIGINT) FROM e WHERE e.config = s.config) AS frames FROM s GROUP BY config""")
def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three configurations cover of the same reference boxes."""
    d = dets(spark, sf_dir)
    passes = F.array(*[F.when(F.col("score") >= v, F.lit(i)) for i, v in CONFIGS])
    results = d.where("score < 0.5").select("media_id", "frame", *"xywh", F.explode(F.array_compact(passes)).alias("config"))
    extents = tracks.extent(spans(spark, sf_dir)).select("label", "total_frames", F.explode(F.sequence(F.lit(0), (F.col("track_id") % 3).cast("int"))).alias("config"))
    return cases.configurations(d.where("score >= 0.5"), results, extents)


@query("""WITH s AS (SELECT user_id AS media_id, event_type AS stage, floor(value * 4) / 4 AS seconds FROM events), c AS (SELECT user_id AS media_id, count(*) * 1000 AS frames, floor(sum(CASE WHEN event_type <> 'error' OR user_id % 2 = 0 THEN floor(value * 4) / 4 ELSE 0 END)) AS seconds FROM events GROUP BY user_id),
 e AS (SELECT media_id, stage, sum(seconds) AS seconds FROM s WHERE stage <> 'error' GROUP BY media_id, stage), u AS (SELECT * FROM e UNION ALL SELECT c.media_id, 'other', greatest(c.seconds - coalesce((SELECT sum(seconds) FROM e WHERE e.media_id = c.media_id), 0), 0) FROM c)
 SELECT u.media_id, stage, round(u.seconds, 3) AS seconds, round(CASE WHEN c.seconds > 0 THEN u.seconds / c.seconds END, 4) AS share, round(CASE WHEN c.seconds > 0 THEN frames / c.seconds END, 1) AS fps FROM u JOIN c USING (media_id)""")
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds and share of each stage of a run, with what no stage accounts for."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_type").alias("stage"), (F.floor(F.col("value") * 4) / 4).alias("seconds"))
    counted = F.when((F.col("stage") != "error") | (F.col("media_id") % 2 == 0), F.col("seconds")).otherwise(0.0)
    clips = e.groupBy("media_id").agg((F.count("*") * 1000).alias("frames"), F.floor(F.sum(counted)).cast("double").alias("seconds"))
    return cases.timing(e.where("stage <> 'error'"), clips)


@query(f"WITH {SIDES}, {share_sql('t', 'truth', 'red', 4)} SELECT (SELECT count(*) FROM (SELECT DISTINCT media_id, frame FROM d) f) AS checked, count(*) AS detections, count(*) FILTER (covered < 0.6::DOUBLE) AS uncovered, round(min(frame) FILTER (covered < 0.6::DOUBLE) / 30, 3) AS first_s FROM t")
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of a verification."""
    d = dets(spark, sf_dir)
    return cases.verify_totals(cases.share_under(d.where("score >= 0.5"), d.where("score < 0.5"), 4), d, FPS, 0.6)
