"""Queries over edited tracks and the rows that go into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import edits
from tessera.sources import sinks
from tessera.sources.adapters import DETS, KEYS, SPANS, dets, keys, spans

from .registry import query

CUT = 250
CLASSES = ("face", "person", "car", "license_plate", "phone")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.nest(spans(spark, sf_dir), keys(spark, sf_dir))


def sizes(df: DataFrame) -> DataFrame:
    return df.select("media_id", "track_id", "span_no", "start_frame", "end_frame", F.size("keys").cast("bigint").alias("n_keys"))


@query(f"""WITH k AS ({KEYS}), s AS ({SPANS}) SELECT s.media_id, s.track_id, s.span_no, greatest(s.start_frame, {CUT}) AS start_frame, s.end_frame,
 count(*) FILTER (k.frame >= {CUT}) + CASE WHEN s.start_frame < {CUT} AND NOT bool_or(k.frame = {CUT}) THEN 1 ELSE 0 END AS n_keys
 FROM s JOIN k ON k.track_id = s.track_id AND k.frame BETWEEN s.start_frame AND s.end_frame WHERE s.end_frame >= {CUT} GROUP BY s.media_id, s.track_id, s.span_no, s.start_frame, s.end_frame""")
def trimmed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks without what lies before a frame; a span cut there has a keyframe at the cut."""
    return sizes(edits.trim_start(nested(spark, sf_dir), CUT))


@query(f"""WITH k AS ({KEYS}), s AS ({SPANS}) SELECT s.media_id, s.track_id, s.span_no, s.start_frame, least(s.end_frame, {CUT}) AS end_frame,
 count(*) FILTER (k.frame <= {CUT}) + CASE WHEN s.end_frame > {CUT} AND NOT bool_or(k.frame = {CUT}) THEN 1 ELSE 0 END AS n_keys
 FROM s JOIN k ON k.track_id = s.track_id AND k.frame BETWEEN s.start_frame AND s.end_frame WHERE s.start_frame <= {CUT} GROUP BY s.media_id, s.track_id, s.span_no, s.start_frame, s.end_frame""")
def trimmed_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks without what lies after a frame."""
    return sizes(edits.trim_end(nested(spark, sf_dir), CUT))


@query(f"""WITH s AS ({SPANS}), r AS (SELECT *, max(CASE WHEN {CUT} BETWEEN start_frame AND end_frame THEN 1 ELSE 0 END) OVER (PARTITION BY track_id) AS inside,
 row_number() OVER (PARTITION BY track_id ORDER BY least(abs(start_frame - {CUT}), abs(end_frame - {CUT})), start_frame, span_no) AS rk FROM s)
 SELECT media_id, track_id, span_no, CASE WHEN inside = 0 AND rk = 1 THEN least(start_frame, {CUT}) ELSE start_frame END AS start_frame,
 CASE WHEN inside = 0 AND rk = 1 THEN greatest(end_frame, {CUT}) ELSE end_frame END AS end_frame, n_keys FROM r""")
def extended_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track made to reach a frame, from its nearest span."""
    return sizes(edits.extend_to(nested(spark, sf_dir), CUT))


@query(f"""WITH k AS ({KEYS}), s AS ({SPANS}) SELECT s.media_id, s.track_id, s.span_no, s.start_frame, s.end_frame, count(*) FILTER (k.frame <> {CUT}) AS n_keys
 FROM s JOIN k ON k.track_id = s.track_id AND k.frame BETWEEN s.start_frame AND s.end_frame GROUP BY s.media_id, s.track_id, s.span_no, s.start_frame, s.end_frame HAVING count(*) FILTER (k.frame <> {CUT}) > 0""")
def removed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks without their keyframe at a frame; spans left empty go."""
    return sizes(edits.remove_key(nested(spark, sf_dir), CUT))


@query(f"""WITH d AS ({DETS}), l AS (SELECT media_id, frame, printf('%d %.6f %.6f %.6f %.6f', list_position({list(CLASSES)}, label) - 1, x + w / 2, y + h / 2, w, h) AS line FROM d)
 SELECT media_id, frame, string_agg(line, chr(10) ORDER BY line) || chr(10) AS text FROM l GROUP BY media_id, frame""")
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file's text per medium and frame."""
    d = dets(spark, sf_dir).withColumnRenamed("label", "cls")
    return sinks.label_lines(d, d, list(CLASSES))
