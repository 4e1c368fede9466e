"""Queries of the small scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars, text
from tessera.sources.adapters import KEYS, SPANS, keys, spans, table

from .registry import query


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock FROM (SELECT event_id, CAST(floor(value * 23) AS BIGINT) AS s FROM events)")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.clock(F.col("value") * 23).alias("clock"))


@query("""WITH v AS (SELECT DISTINCT 'v' || user_id % 3 || '.' || user_id % 12 || CASE user_id % 2 WHEN 0 THEN '.' || user_id % 5 ELSE '' END AS name, [user_id % 3, user_id % 12] || CASE user_id % 2 WHEN 0 THEN [user_id % 5] ELSE [] END AS parts FROM events)
 SELECT a.name AS name, b.name AS than, a.parts > b.parts AS newer FROM v a, v b""")
def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the versions in use comes after which (a stated list of names against itself)."""
    u = F.col("user_id")
    name = F.concat(F.lit("v"), u % 3, F.lit("."), u % 12, F.when(u % 2 == 0, F.concat(F.lit("."), u % 5)).otherwise(F.lit("")))
    others = table(spark, sf_dir, "events").agg(F.array_sort(F.collect_set(name)).alias("names"))  # 60 names at most
    return others.select(F.explode("names").alias("name"), "names").select("name", F.explode("names").alias("than")).select("name", "than", scalars.is_newer(F.col("name"), F.col("than")).alias("newer"))


MODE = "CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'auto' WHEN 'purchase' THEN 'OFF' WHEN 'error' THEN 'strong' END"


@query(f"SELECT mode, count(*) AS n FROM (SELECT CASE WHEN m IS NULL OR lower(m) IN ('', 'false', '0', 'off', 'none') THEN 'off' WHEN lower(m) IN ('true', '1', 'always') THEN 'always' ELSE 'auto' END AS mode FROM (SELECT {MODE} AS m FROM events)) GROUP BY mode")
def boost_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(scalars.boost_mode(F.expr(MODE)).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


OPTION = "CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN CAST(user_id AS VARCHAR(9)) WHEN 2 THEN '0.5' WHEN 3 THEN 'fast' ELSE '-7' END"


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'bool' WHEN 2 THEN 'float' WHEN 3 THEN 'str' ELSE 'int' END AS kind, count(*) AS n FROM events GROUP BY 1")
def option_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(scalars.option_kind(F.expr(OPTION)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH s AS ({SPANS}) SELECT track_id, span_no, list_sort(list_distinct([start_frame + CAST(floor((end_frame - start_frame) * (k / 4.0::DOUBLE)) AS BIGINT) FOR k IN range(5)])) AS frames FROM s")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced frames of every span."""
    return spans(spark, sf_dir).select("track_id", "span_no", F.array_sort(scalars.evenly_spaced(F.col("start_frame"), F.col("end_frame"), 5)).alias("frames"))


@query(f"""WITH k AS ({KEYS}), d AS (SELECT track_id, frame, x - lag(x) OVER (PARTITION BY track_id ORDER BY frame) AS dx FROM k), l AS (SELECT track_id, list(dx ORDER BY frame) AS steps FROM d WHERE dx IS NOT NULL GROUP BY track_id)
 SELECT track_id, list_reduce(list_concat([0.0::DOUBLE], steps), lambda v, s: v * 0.7::DOUBLE + s * (1 - 0.7::DOUBLE)) AS speed FROM l""")
def smoothed_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed step of each track from keyframe to keyframe."""
    from pyspark.sql import Window as W

    step = (F.col("x") - F.lag("x").over(W.partitionBy("track_id").orderBy("frame"))).alias("dx")
    d = keys(spark, sf_dir).select("track_id", "frame", step).where("dx is not null")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("frame", "dx"))), lambda s: s["dx"])
    return d.groupBy("track_id").agg(scalars.smoothed(steps).alias("speed"))


SEGMENTS = "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Thank you.' WHEN 1 THEN 'uh' WHEN 2 THEN 'oh my' ELSE text END AS text, ((conv_id * 31 + turn * 7) % 100) / 100 AS no_speech FROM conversations"


@query(f"""WITH s AS ({SEGMENTS}), p AS (SELECT *, trim(regexp_replace(lower(text), '[^\\pL\\pN\\pM_\\s'']+', '', 'g')) AS plain FROM s)
 SELECT conv_id, turn, text, no_speech FROM p WHERE trim(text) <> '' AND NOT (no_speech >= 0.85::DOUBLE AND ((plain IN {text.FILLERS} AND len(regexp_split_to_array(plain, '\\s+')) <= 2) OR length(plain) <= 3))""")
def without_fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are not a filler heard in silence."""
    return text.without_fillers(spark.sql(SEGMENTS.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations")))
