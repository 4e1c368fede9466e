"""Search and clusters of people, against brute force."""

import numpy as np

from tessera.operators import identity

VEC = "track_id long, sample long, vec array<double>"


def unit(*v):
    v = np.array(v, float)
    return [float(x) for x in v / np.linalg.norm(v)]


def test_search_in_blocks_is_the_search_in_one(spark, tmp_path):
    rng = np.random.default_rng(3)
    vecs = [unit(*rng.normal(size=6)) for _ in range(60)]
    samples = spark.createDataFrame([(k // 3, k, v) for k, v in enumerate(vecs)] + [(50, 99, None)], VEC)
    queries = samples.where("sample % 4 = 0").selectExpr("track_id subject", "vec")
    want = {}
    for i in range(0, 60, 4):
        for j in range(60):
            s = float(np.dot(vecs[i], vecs[j]))
            if i // 3 != j // 3 and s >= 0.363:
                want[i // 3, j // 3] = max(s, want.get((i // 3, j // 3), -1))
    for block, folder in ((4, False), (4096, False), (4, True), (5, True)):
        if folder:
            spark.sparkContext.setCheckpointDir(str(tmp_path))
        got = {(r.subject, r.track_id): r.similarity for r in identity.best_cosines(queries, samples, 0.363, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert identity.best_cosines(queries.where("false"), samples, 0.363).count() == 0


def test_who_is_seen_beside_the_subject_is_somebody_else(spark):
    samples = spark.createDataFrame([(1, 0, unit(1, 0)), (2, 1, unit(1, 0.1)), (3, 2, unit(1, 0.2)), (4, 3, unit(1, 0)), (5, 4, unit(0, 1))], VEC)
    tracks = spark.createDataFrame([(1, "face"), (2, "face"), (3, "face"), (4, "car"), (5, "face"), (6, "face")], "track_id long, label string")
    together = spark.createDataFrame([(1, 2, 16), (1, 3, 15), (1, 6, 2)], "a long, b long, frames long")
    queries = samples.where("track_id = 1").selectExpr("track_id subject", "vec")
    assert [(r.subject, r.track_id, r.samples) for r in identity.same_person(queries, samples, tracks, together, 30).collect()] == [(1, 3, 1)]
    (r,) = identity.left_out(queries, samples, tracks, together, 30).collect()
    assert (r.covisible, r.unusable) == (1, 1)


def test_a_track_goes_with_most_of_its_samples(spark):
    rows = [(7, 1, 0, unit(1, 0)), (7, 1, 1, unit(1, 0.1)), (7, 1, 2, unit(-1, 1)), (7, 2, 3, unit(1, 0.05)), (7, 3, 4, unit(-1, 0.9)), (8, 9, 0, unit(0, 1))]
    who = identity.clusters(spark.createDataFrame(rows, "media_id long, " + VEC), "media_id")
    got = {(r.media_id, r.track_id): r.person for r in who.collect()}
    assert got[7, 1] == got[7, 2] != got[7, 3] and (8, 9) in got
    extents = spark.createDataFrame([(1, 1800), (2, 900), (3, 60)], "track_id long, total_frames long")
    first = identity.people(who, extents, "media_id", 30).where("media_id = 7 and rank = 1").first()
    assert first.tracks == 2 and abs(first.minutes - 1.5) < 1e-9
