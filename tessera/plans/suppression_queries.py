"""Queries of plain suppression and of the plate rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import suppression
from tessera.sources.adapters import DETS, dets

from .detection_queries import iou_sql
from .registry import query

STRUCT = "STRUCT(det_no BIGINT, score DOUBLE, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)"


def kept_sql(by: str, most: float) -> str:
    """``k`` from ``d``: the lists of boxes that plain suppression keeps."""
    return f"""g AS (SELECT {by}, list(CAST({{'det_no': det_no, 'score': score, 'x': x, 'y': y, 'w': w, 'h': h}} AS {STRUCT}) ORDER BY score DESC, det_no) AS l FROM d GROUP BY {by}),
 k AS (SELECT {by}, list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda o: {iou_sql('o', 'b')} > {most}::DOUBLE)) > 0 THEN kept ELSE list_append(kept, b) END, CAST([] AS {STRUCT}[])) AS l FROM g)"""


@query(f"WITH d AS ({DETS}), {kept_sql('media_id, frame, label', 0.2)} SELECT media_id, frame, label, b.det_no, b.score, b.x, b.y, b.w, b.h FROM (SELECT media_id, frame, label, unnest(l) AS b FROM k) u")
def nms_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best boxes of each label and frame."""
    return suppression.suppress(dets(spark, sf_dir), ["media_id", "frame", "label"], 0.2)


# A picture of 1280 x 720 in an input of 384 x 384: scaled by 0.3, with bars of 84 above and below.
ROWS = "SELECT det_no, media_id, frame, score, x * 384 AS x0, y * 384 AS y0, (x + w * 2) * 384 AS x1, (y + h) * 384 AS y1"


@query(f"""WITH r AS ({ROWS} FROM ({DETS}) e), f AS (SELECT det_no, media_id, frame, score, least(greatest(x0 / 0.3::DOUBLE, 0), 1280) AS x0, least(greatest((y0 - 84) / 0.3::DOUBLE, 0), 720) AS y0, least(greatest(x1 / 0.3::DOUBLE, 0), 1280) AS x1, least(greatest((y1 - 84) / 0.3::DOUBLE, 0), 720) AS y1 FROM r
  WHERE score >= 0.3::DOUBLE AND x1 - x0 >= 6 AND y1 - y0 >= 3 AND (x1 - x0) / (y1 - y0) BETWEEN 1.1::DOUBLE AND 8 AND (x1 - x0) * (y1 - y0) <= 0.35::DOUBLE * 384 * 384),
 p AS (SELECT *, greatest(y0 - (y1 - y0) * 0.1::DOUBLE, 0) AS a, least(y1 + (y1 - y0) * 0.1::DOUBLE, 720) AS b FROM f WHERE x1 - x0 >= 4 AND y1 - y0 >= 3),
 d AS (SELECT det_no, media_id, frame, score, x0 / 1280 AS x, a / 720 AS y, least((x1 - x0) / 1280, 1 - x0 / 1280) AS w, least((b - a) / 720, 1 - a / 720) AS h FROM p), {kept_sql('media_id, frame', 0.55)}
 SELECT media_id, frame, b.det_no, b.score, round(b.x, 9) AS x, round(b.y, 9) AS y, round(b.w, 9) AS w, round(b.h, 9) AS h FROM (SELECT media_id, frame, unnest(l[1:20]) AS b FROM k) u""")
def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates from the raw rows of a detector."""
    rows = dets(spark, sf_dir).selectExpr(*(c.strip() for c in ROWS.removeprefix("SELECT ").split(",")))
    got = suppression.plates(rows, ["media_id", "frame"], (1280, 720), 0.3, (0.0, 84.0), 0.3)
    return got.select("media_id", "frame", "det_no", "score", *[F.round(c, 9).alias(c) for c in "xywh"])
