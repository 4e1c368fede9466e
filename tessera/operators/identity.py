"""Who is who among tracks: search by the best cosine of face vectors, and clusters of people."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.operators import greedy

SAME_PERSON = 0.363
TOGETHER_S = 0.5
BLOCK = 4096  # query vectors that one pass over the table holds


def best_cosines(queries: DataFrame, samples: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(subject, track_id, similarity) of every pair of tracks whose best cosine is at least ``least``.

    ``queries`` (subject, vec) are taken ``block`` at a time, and each block meets every row of ``samples`` (track_id, vec) where
    that row lies: a task holds one block and one batch, only pairs above ``least`` leave it, and nothing else is shuffled.
    Where the cluster has a checkpoint folder, the pairs of a full block are written there before the next one is fetched, so the
    driver holds one block whatever their number; without one all blocks stay with the plan.  Unit vectors are expected; a null
    one meets nothing.
    """
    asked = queries.where("vec is not null").select("subject", "vec")
    known = samples.where("vec is not null").select("track_id", "vec")
    schema = "subject long, track_id long, similarity double"
    parts, held = [], []
    written = samples.sparkSession.sparkContext.getCheckpointDir() is not None

    def of(rows: list) -> DataFrame:
        owners, matrix = np.array([r.subject for r in rows]), np.array([r.vec for r in rows], float)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                tracks = batch.column("track_id").to_numpy(zero_copy_only=False)
                vecs = np.array(batch.column("vec").to_pylist(), float)
                over = vecs @ matrix.T
                i, j = np.nonzero((over >= least) & (tracks[:, None] != owners[None]))
                yield pa.RecordBatch.from_arrays([pa.array(owners[j], pa.int64()), pa.array(tracks[i], pa.int64()), pa.array(over[i, j], pa.float64())], names=["subject", "track_id", "similarity"])

        return known.mapInArrow(run, schema)

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            parts.append(of(held).checkpoint() if written else of(held))
            held = []
    if held or not parts:
        parts.append(of(held) if held else samples.sparkSession.createDataFrame([], schema))
    if len(parts) > 64 and not written:
        warnings.warn(f"{len(parts)} blocks of queries stay on the driver; name a folder in spark.checkpoint.dir", stacklevel=2)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("subject", "track_id").agg(F.max("similarity").alias("similarity"))


def seen_together(together: DataFrame, fps: float, most_s: float = TOGETHER_S) -> DataFrame:
    """(subject, track_id) both ways of the pairs (a, b, frames) that share the picture for longer than ``most_s``."""
    long_ = together.where(F.col("frames") > most_s * fps)
    return long_.select(F.col("a").alias("subject"), F.col("b").alias("track_id")).unionByName(long_.select(F.col("b").alias("subject"), F.col("a").alias("track_id")))


def same_person(queries: DataFrame, samples: DataFrame, tracks: DataFrame, together: DataFrame, fps: float, least: float = SAME_PERSON, label: str = "face") -> DataFrame:
    """Tracks of ``label`` that show the subject's person, with their number of samples; whoever is seen beside the subject is
    somebody else, however alike."""
    face = tracks.where(F.col("label") == label).select("track_id").distinct()
    theirs = samples.join(face, "track_id", "left_semi")
    sizes = theirs.groupBy("track_id").agg(F.count("vec").alias("samples"))
    found = best_cosines(queries, theirs, least).join(seen_together(together, fps), ["subject", "track_id"], "left_anti")
    return found.join(sizes, "track_id").select("subject", "track_id", "similarity", "samples")


def left_out(subjects: DataFrame, samples: DataFrame, tracks: DataFrame, together: DataFrame, fps: float, label: str = "face") -> DataFrame:
    """(subject, covisible, unusable): how many tracks of ``label`` were passed over as seen beside the subject, and how many of
    the others have no sample.

    Tracks without a sample are counted once and those beside the subject, few, are taken off, so no pair is built.
    """
    face = tracks.where(F.col("label") == label).select("track_id").distinct()
    bare = face.join(samples.where("vec is not null"), "track_id", "left_anti").withColumn("bare", F.lit(1))
    beside = seen_together(together, fps).join(face, "track_id", "left_semi").join(bare, "track_id", "left")
    each = beside.groupBy("subject").agg(F.count("*").alias("covisible"), F.count("bare").alias("bare_beside"))
    own = subjects.select("subject").distinct().join(bare.select(F.col("track_id").alias("subject"), F.col("bare").alias("own")), "subject", "left")
    total = bare.agg(F.count("*").alias("total"))
    got = own.join(each, "subject", "left").join(F.broadcast(total))  # one row
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return got.select("subject", count("covisible").alias("covisible"), (F.col("total") - count("own") - count("bare_beside")).alias("unusable"))


def clusters(samples: DataFrame, by: str, least: float = 0.3) -> DataFrame:
    """(``by``, track_id, person) by average linkage of the samples (``by``, track_id, sample, vec) of one recording.

    A person is a cluster, a track belongs to the one that holds most of its samples (the first of equals); ``least`` is the mean
    cosine at which clusters still join.  A recording bounds the group.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["track_id", "sample"])
        m = np.stack([np.asarray(v, float) for v in pdf["vec"]])
        return pd.DataFrame({by: pdf[by], "track_id": pdf["track_id"], "person": greedy.cluster_average(m @ m.T, least)})

    each = samples.where("vec is not null").select(by, "track_id", "sample", "vec").groupBy(by).applyInPandas(run, f"{by} long, track_id long, person int")
    votes = each.groupBy(by, "track_id", "person").agg(F.count("*").alias("n"))
    return votes.groupBy(by, "track_id").agg(F.max_by("person", F.struct("n", -F.col("person"))).alias("person"))


def people(who: DataFrame, extents: DataFrame, by: str, fps: float) -> DataFrame:
    """(``by``, person, tracks, minutes, rank): how much of a recording shows each person, the most often seen first."""
    each = who.join(extents.select("track_id", "total_frames"), "track_id", "left").groupBy(by, "person").agg(F.count("*").alias("tracks"), F.round(F.coalesce(F.sum("total_frames"), F.lit(0)) / fps / 60, 4).alias("minutes"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("tracks"), F.desc("person"))))
