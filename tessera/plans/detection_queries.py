"""Queries over detections: geometry, gates, fusion, coverage and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import Box
from tessera.operators import gates, greedy
from tessera.operators.intervals import gap_runs
from tessera.sources.adapters import DETS, dets, table

from .registry import query

INTER = "greatest(least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x), 0) * greatest(least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y), 0)"


def inter(a: str, b: str) -> str:
    return INTER.format(a=f"{a}." if a else "", b=f"{b}." if b else "")


def iou_sql(a: str, b: str) -> str:
    return f"(({inter(a, b)}) / ({a}.w * {a}.h + {b}.w * {b}.h - ({inter(a, b)})))"


def edge(v: str, size: int) -> str:
    return f"CAST(greatest(0, least({size}, round_even({v}, 0))) AS INTEGER)"


@query(f"WITH d AS ({DETS}) SELECT det_no, {edge('(x - w * 0.125::DOUBLE) * 1280', 1280)} AS x0, {edge('(y - h * 0.125::DOUBLE) * 720', 720)} AS y0, {edge('(x + w + w * 0.125::DOUBLE) * 1280', 1280)} AS x1, {edge('(y + h + h * 0.125::DOUBLE) * 720', 720)} AS y1 FROM d")
def box_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dets(spark, sf_dir).select("det_no", *g.to_pixels(Box.of(), 1280, 720, 0.125))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the same medium, frame and label, each pair once."""
    d = dets(spark, sf_dir)
    left = d.select("media_id", "frame", "label", F.col("det_no").alias("a"), *Box.of().columns("a_"))
    right = d.select("media_id", "frame", "label", F.col("det_no").alias("b"), *Box.of().columns("b_"))
    return left.join(right, ["media_id", "frame", "label"]).where("a < b")


@query(f"WITH d AS ({DETS}) SELECT p.det_no AS a, q.det_no AS b, {iou_sql('p', 'q')} AS iou FROM d p JOIN d q ON p.media_id = q.media_id AND p.frame = q.frame AND p.label = q.label AND p.det_no < q.det_no WHERE {inter('p', 'q')} > 0")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("a", "b", g.iou(Box.of("a_"), Box.of("b_")).alias("iou")).where("iou > 0")


@query(f"WITH d AS ({DETS}) SELECT p.det_no AS a, q.det_no AS b FROM d p JOIN d q ON p.media_id = q.media_id AND p.frame = q.frame AND p.label = q.label AND p.det_no < q.det_no WHERE {inter('p', 'q')} >= 0.85::DOUBLE * (q.w * q.h)")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).where(g.contains(Box.of("a_"), Box.of("b_"), 0.85)).select("a", "b")


@query(f"WITH d AS ({DETS}) SELECT label, count(*) AS n, avg(score) AS mean_score, max(score) AS best FROM d WHERE score > CASE label WHEN 'face' THEN 0.75::DOUBLE WHEN 'license_plate' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AND frame % 5 = 0 GROUP BY label")
def sampled_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame's detections above their label's own threshold, by label."""
    least = F.when(F.col("label") == "face", 0.75).when(F.col("label") == "license_plate", 0.25).otherwise(0.5)
    return dets(spark, sf_dir).where((F.col("score") > least) & (F.col("frame") % 5 == 0)).groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("best"))


GROWN = "(SELECT media_id, frame, least(greatest(x - 0.08::DOUBLE * w, 0), 1) AS x, least(greatest(y - 0.08::DOUBLE * h, 0), 1) AS y, least(greatest(x + 1.08::DOUBLE * w, 0), 1) - least(greatest(x - 0.08::DOUBLE * w, 0), 1) AS w, least(greatest(y + 1.08::DOUBLE * h, 0), 1) - least(greatest(y - 0.08::DOUBLE * h, 0), 1) AS h FROM d WHERE label = 'car')"


@query(f"WITH d AS ({DETS}), v AS {GROWN} SELECT det_no, media_id, frame, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.media_id = d.media_id AND v.frame = d.frame AND {inter('v', 'd')} >= 0.6::DOUBLE * (d.w * d.h)) THEN 'plate' ELSE 'plate_ungated' END AS gated FROM d WHERE label = 'license_plate'")
def vehicle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates by three fifths inside a grown vehicle of their frame, and those that are not."""
    return gates.vehicle_gate(dets(spark, sf_dir))


@query(f"""WITH d AS ({DETS}) SELECT det_no, media_id, frame, x + w * ((1 - 0.45::DOUBLE) / 2) AS x, y, w * 0.45::DOUBLE AS w, h * 0.22::DOUBLE AS h, score * 0.9::DOUBLE AS score FROM d
 WHERE label = 'person' AND h >= 0.12::DOUBLE AND w <= 1.3::DOUBLE * h AND NOT EXISTS (SELECT 1 FROM d f WHERE f.label = 'face' AND f.media_id = d.media_id AND f.frame = d.frame AND {inter('d', 'f')} >= 0.5::DOUBLE * (f.w * f.h))""")
def head_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons without a face get a box where the head should be."""
    return gates.head_fallback(dets(spark, sf_dir))


@query(f"WITH d AS ({DETS}) SELECT media_id, frame, det_no, area FROM (SELECT *, w * h AS area, row_number() OVER (PARTITION BY media_id, frame ORDER BY w * h DESC, det_no) AS rn FROM d WHERE label = 'car') t WHERE rn <= 4 AND area < 0.6::DOUBLE AND w * 1280 >= 48 AND h * 720 >= 48")
def top_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest vehicles of each frame, taken before the size limits are applied."""
    return gates.vehicle_crops(dets(spark, sf_dir))


@query(f"""WITH d AS ({DETS}) SELECT * EXCLUDE (source) FROM d WHERE label = 'face' AND NOT EXISTS (SELECT 1 FROM d s WHERE s.label = 'phone' AND s.media_id = d.media_id AND s.frame = d.frame AND {iou_sql('d', 's')} > 0.3::DOUBLE)""")
def off_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that no screen of their frame overlaps (faces against phones here)."""
    d = dets(spark, sf_dir).drop("source")
    return gates.off_screens(d.where("label = 'face'"), d.where("label = 'phone'"))


@query(f"""WITH d AS ({DETS}), base AS (SELECT * EXCLUDE (source) FROM d WHERE score >= 0.5::DOUBLE), extra AS (SELECT * EXCLUDE (source) FROM d WHERE score < 0.5::DOUBLE AND w * h > 0 AND greatest(least(x + w, 0.25::DOUBLE) - greatest(x, 0), 0) * greatest(least(y + h, 1) - greatest(y, 0), 0) >= 0.25::DOUBLE * (w * h))
 SELECT * FROM base UNION ALL SELECT * FROM extra e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.media_id = e.media_id AND b.frame = e.frame AND b.label = e.label AND {iou_sql('e', 'b')} >= 0.3::DOUBLE)""")
def edge_assisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass over the left quarter adds what the first did not see."""
    d = dets(spark, sf_dir).drop("source")
    strip = Box(*(F.lit(v) for v in (0.0, 0.0, 0.25, 1.0)))
    return gates.edge_assist(d.where("score >= 0.5"), d.where("score < 0.5"), strip)


# Coverage: detections with a score of half or more are the truth, the rest (grown by an eighth) the redactions.
CELLS = "(SELECT i, j FROM range(4) a(i), range(4) b(j))"
COVERAGE = f"""d AS ({DETS}), truth AS (SELECT * FROM d WHERE score >= 0.5::DOUBLE), boxes AS (SELECT media_id, frame, x - w / 8 AS x0, y - h / 8 AS y0, x + w + w / 8 AS x1, y + h + h / 8 AS y1 FROM d WHERE score < 0.5::DOUBLE),
 cells AS (SELECT det_no, t.media_id, t.frame, label, x + w * (i + 0.5::DOUBLE) / 4 AS px, y + h * (j + 0.5::DOUBLE) / 4 AS py FROM truth t, {CELLS} c),
 share AS (SELECT det_no, media_id, frame, label, avg(CASE WHEN EXISTS (SELECT 1 FROM boxes b WHERE b.media_id = c.media_id AND b.frame = c.frame AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS covered FROM cells c GROUP BY det_no, media_id, frame, label)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(det_no, media_id, frame, label, covered): share of each true box under the redactions of its frame."""
    d = dets(spark, sf_dir)
    truth = d.where("score >= 0.5").select("det_no", "media_id", "frame", "label", *Box.of().columns())
    edges = F.struct((F.col("x") - F.col("w") / 8).alias("x0"), (F.col("y") - F.col("h") / 8).alias("y0"), (F.col("x") + F.col("w") + F.col("w") / 8).alias("x1"), (F.col("y") + F.col("h") + F.col("h") / 8).alias("y1"))
    boxes = d.where("score < 0.5").groupBy("media_id", "frame").agg(F.collect_list(edges).alias("covers"))  # a frame's boxes are few
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    both = truth.join(boxes, ["media_id", "frame"], "left").withColumn("covers", F.coalesce("covers", none))
    return both.select("det_no", "media_id", "frame", "label", g.covered_share(Box.of(), F.col("covers"), 4).alias("covered"))


@query(f"WITH {COVERAGE} SELECT det_no, media_id, frame, label, covered FROM share WHERE covered < 0.6::DOUBLE")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir).where("covered < 0.6")


@query(f"""WITH {COVERAGE}, frames AS (SELECT count(*) AS n FROM (SELECT DISTINCT media_id, frame FROM d) f)
 SELECT coalesce(label, 'all') AS label, count(*) AS boxes, count(*) FILTER (covered >= 0.9::DOUBLE) AS covered_90, round(avg(CASE WHEN covered >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, count(DISTINCT CASE WHEN covered < 0.9::DOUBLE THEN media_id * 1000000000 + frame END) AS leak_frames,
  round(count(DISTINCT CASE WHEN covered < 0.9::DOUBLE THEN media_id * 1000000000 + frame END) / (SELECT n FROM frames), 6) AS leak_rate FROM share GROUP BY GROUPING SETS ((label), ())""")
def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 90 % and leak rate by label and in total; all labelled frames are the denominator."""
    frames = dets(spark, sf_dir).select("media_id", "frame").distinct().agg(F.count("*").alias("frames"))
    leak = F.when(F.col("covered") < 0.9, F.col("media_id") * 1000000000 + F.col("frame"))
    by = coverage(spark, sf_dir).rollup("label").agg(F.count("*").alias("boxes"), F.count(F.when(F.col("covered") >= 0.9, 1)).alias("covered_90"), F.round(F.avg((F.col("covered") >= 0.9).cast("double")), 6).alias("recall"), F.countDistinct(leak).alias("leak_frames"))
    return by.join(F.broadcast(frames)).select(F.coalesce("label", F.lit("all")).alias("label"), "boxes", "covered_90", "recall", "leak_frames", F.round(F.col("leak_frames") / F.col("frames"), 6).alias("leak_rate"))  # one row


@query(f"""WITH {COVERAGE}, p AS (SELECT DISTINCT media_id, label, frame FROM share WHERE covered < 0.9::DOUBLE),
 r AS (SELECT *, sum(new) OVER (PARTITION BY media_id, label ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY media_id, label ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS new FROM p) x)
 SELECT media_id, label, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS points, max(frame) - min(frame) + 2 AS frames FROM r GROUP BY media_id, label, run""")
def leak_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of frames in which something of a label stays uncovered."""
    points = coverage(spark, sf_dir).where("covered < 0.9").select("media_id", "label", "frame").distinct()
    return gap_runs(points, ["media_id", "label"], "frame", 2)


@query(f"""WITH d AS ({DETS}), t AS (SELECT * FROM d WHERE score >= 0.5::DOUBLE) SELECT det_no, media_id, frame, label FROM d WHERE score < 0.5::DOUBLE AND NOT EXISTS (SELECT 1 FROM t WHERE t.media_id = d.media_id AND t.frame = d.frame AND t.label = d.label AND {inter('t', 'd')} > 0)""")
def extra_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions that touch no true box of their label."""
    d = dets(spark, sf_dir)
    boxes = d.where("score < 0.5").select("det_no", "media_id", "frame", "label", *Box.of().columns())
    truth = d.where("score >= 0.5").select("media_id", "frame", "label", *Box.of().columns("t_"))
    hit = boxes.join(truth, ["media_id", "frame", "label"]).where(g.intersection(Box.of(), Box.of("t_")) > 0).select("det_no").distinct()
    return boxes.join(hit, "det_no", "left_anti").select("det_no", "media_id", "frame", "label")


@query()
def nms_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.fuse_frames(dets(spark, sf_dir), ["media_id", "frame"])


def _grouped(df: DataFrame, by: list[str], schema: str, each) -> DataFrame:
    """``each`` over the sorted rows of a medium's label (bounded by the medium)."""

    def run(pdf):
        import pandas as pd

        return pd.DataFrame(each(pdf), columns=[c.split()[0] for c in schema.split(", ")])

    return df.groupBy(*by).applyInPandas(run, schema)


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's detections matched one to one with those of the frame before, by label."""
    return greedy.match_neighbours(dets(spark, sf_dir), ["media_id", "label"]).select("media_id", "frame", "before", "det_no", "iou")


@query()
def associated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live tracks over a medium's frames: matched, missed, closed after eight misses."""

    def each(pdf):
        pdf = pdf.sort_values(["frame", "det_no"])
        n = greedy.associate(list(pdf[["frame", "score", "x", "y", "w", "h"]].itertuples(index=False, name=None)))
        return [(int(a), b, int(c), int(d), k) for a, b, c, d, k in zip(pdf["media_id"], pdf["label"], pdf["frame"], pdf["det_no"], n, strict=True)]

    return _grouped(dets(spark, sf_dir), ["media_id", "label"], "media_id long, label string, frame long, det_no long, track_no int", each)


COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


@query(f"""SELECT a.label, count(*) AS pairs, round(avg({COS}), 5) AS mean_similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) a JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) b ON a.label = b.label AND b.n = a.n + 1 GROUP BY a.label""")
def identity_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of consecutive samples of each label."""
    w = W.partitionBy("label").orderBy("vec_id")
    pairs_ = table(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(w)).where("next is not null")
    return pairs_.groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.avg(g.cosine(F.col("embedding"), F.col("next"))), 5).alias("mean_similarity"))
