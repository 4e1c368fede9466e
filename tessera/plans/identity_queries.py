"""Queries of the search for a person and of clusters of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import identity, tracks
from tessera.sources.adapters import SPANS, spans, table

from .registry import query

FPS = 30

# Five vectors make a track's samples; the query set is every vector whose id is divisible by 100, against all vectors.
SAMPLES = "SELECT vec_id, vec_id // 5 AS track_id, embedding AS vec FROM embeddings"
FACES = f"""s AS ({SPANS}), v AS ({SAMPLES}), t AS (SELECT DISTINCT track_id FROM s WHERE label = 'face'),
 o AS (SELECT a.track_id AS a, b.track_id AS b, sum(least(a.end_frame, b.end_frame) - greatest(a.start_frame, b.start_frame) + 1) AS frames FROM s a JOIN s b ON a.media_id = b.media_id AND a.track_id <> b.track_id AND a.start_frame <= b.end_frame AND b.start_frame <= a.end_frame GROUP BY a.track_id, b.track_id),
 beside AS (SELECT a AS subject, b AS track_id FROM o WHERE frames > 15)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 5").alias("track_id"), F.col("embedding").alias("vec"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("track_id").alias("subject"), "vec")


@query(f"""WITH {FACES}, p AS (SELECT q.track_id AS subject, b.track_id AS track_id, max(list_sum(list_transform(range(1, 65), lambda i: q.vec[i]::DOUBLE * b.vec[i]::DOUBLE))) AS best, count(DISTINCT b.vec_id) AS samples
 FROM v q JOIN v b ON q.track_id <> b.track_id WHERE q.vec_id % 100 = 0 AND b.track_id IN (SELECT track_id FROM t) GROUP BY q.track_id, b.track_id)
 SELECT subject, track_id, round(best, 5) AS similarity, samples FROM p WHERE best >= 0.363::DOUBLE AND NOT EXISTS (SELECT 1 FROM beside c WHERE c.subject = p.subject AND c.track_id = p.track_id)""")
def same_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face tracks that show the subjects' persons, without those seen beside them for over half a second."""
    s = spans(spark, sf_dir)
    found = identity.same_person(asked(spark, sf_dir), samples(spark, sf_dir), s, tracks.covisible(s), FPS)
    return found.withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {FACES}, q AS (SELECT DISTINCT track_id AS subject FROM v WHERE vec_id % 100 = 0)
 SELECT subject, (SELECT count(*) FROM beside c JOIN t USING (track_id) WHERE c.subject = q.subject) AS covisible,
  (SELECT count(*) FROM t WHERE t.track_id <> q.subject AND t.track_id NOT IN (SELECT track_id FROM v) AND NOT EXISTS (SELECT 1 FROM beside c WHERE c.subject = q.subject AND c.track_id = t.track_id)) AS unusable FROM q""")
def same_person_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many face tracks the search passed over, and why."""
    s = spans(spark, sf_dir)
    return identity.left_out(asked(spark, sf_dir), samples(spark, sf_dir), s, tracks.covisible(s), FPS)


@query()
def identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of each recording (eight tracks make one) with their tracks and minutes."""
    v = samples(spark, sf_dir).select(F.expr("track_id div 8").alias("media_id"), "track_id", F.col("vec_id").alias("sample"), "vec")
    return identity.people(identity.clusters(v, "media_id"), tracks.extent(spans(spark, sf_dir)), "media_id", FPS)
