import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import greedy, intervals, tracks


def test_merge_ranges_and_spans(spark):
    r = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.5, 2.0), (1, 3.0, 4.0), (1, 4.0, 5.0), (1, 7.0, 7.0)], "m int, start_s double, end_s double")
    assert sorted((x.start_s, x.end_s) for x in intervals.merge_ranges(r, ["m"]).collect()) == [(0.0, 2.0), (3.0, 5.0)]
    s = spark.createDataFrame([(1, 0, 5), (1, 6, 9), (1, 20, 30)], "t int, start_frame int, end_frame int")
    once = intervals.merge_spans(s, ["t"])
    assert sorted((x.start_frame, x.end_frame) for x in once.collect()) == [(0, 9), (20, 30)]
    assert sorted((x.start_frame, x.end_frame) for x in intervals.merge_spans(once.drop("n_spans"), ["t"]).collect()) == [(0, 9), (20, 30)]


def test_overlap_join_is_the_nested_loop(spark):
    rng = np.random.default_rng(3)
    a = [(int(k % 3), int(s), int(s + d), k) for k, (s, d) in enumerate(rng.integers(0, 60, (40, 2)))]
    b = [(int(k % 3), int(s), int(s + d), k) for k, (s, d) in enumerate(rng.integers(0, 60, (40, 2)))]
    got = intervals.overlap_join(spark.createDataFrame(a, "m int, a0 int, a1 int, i int"), spark.createDataFrame(b, "m int, b0 int, b1 int, j int"), ["m"], 7, ("a0", "a1"), ("b0", "b1")).select("i", "j").collect()
    want = [(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_interpolation_holds_at_the_ends(spark):
    k = spark.createDataFrame([(1, 5, 0.0, 0.0, 0.1, 0.1), (1, 15, 0.5, 0.5, 0.1, 0.1)], "t int, frame int, x double, y double, w double, h double")
    f = spark.createDataFrame([(1, 0), (1, 10), (1, 15), (1, 20)], "t int, frame int")
    got = {r.frame: r.x for r in intervals.interpolate(f, k, ["t"]).collect()}
    assert got == {0: 0.0, 10: 0.25, 15: 0.5, 20: 0.5}


def words(spark, *sentences):
    rows = [(1, k, w, k * 0.5, k * 0.5 + 0.4) for k, w in enumerate(" ".join(sentences).split())]
    return spark.createDataFrame(rows, "media_id long, idx long, word string, start_s double, end_s double").withColumn("norm", text.norm_token(F.col("word")))


def test_tokens_and_phrases(spark):
    w = words(spark, "Michael Carter said hi.", "Yes, michael CARTER! Niño's")
    assert [r.norm for r in w.orderBy("idx").collect()][-1] == "nino's"
    hits = text.phrase_hits(w, ["michael CARTER!"]).orderBy("idx").collect()
    assert [(h.idx, h.start_s, h.hit_end_s) for h in hits] == [(0, 0.0, 0.9), (5, 2.5, 3.4)]
    assert text.phrase_hits(w, ["  "]).count() == 0


def test_pii_rules(spark):
    w = words(spark, "My name is Dana Reed. Call five five five, oh one nine nine two two one.", "I live at 12 Old Mill Road and was born on March third 1990 mail a@b.org plate A B C 1 2")
    got = {(r.kind, r.text) for r in text.pii_suggestions(w).collect()}
    assert {k for k, _ in got} == {"name", "phone", "address", "dob", "email", "plate"}
    assert ("address", "12 Old Mill Road") in got and ("email", "a@b.org") in got and ("name", "Dana Reed. Call") in got


def test_fuse_match_simplify_link():
    boxes = np.array([(0.1, 0.1, 0.2, 0.2), (0.11, 0.1, 0.2, 0.2), (0.7, 0.7, 0.1, 0.1), (0.1, 0.1, 0.2, 0.2)])
    got = greedy.fuse(boxes, np.array([0.9, 0.7, 0.5, 0.4]), ["face", "face", "face", "person"], ["a", "b", "c", "a"])
    assert len(got) == 3 and got[0][6] == "a+b" and got[0][1] == 0.9
    assert greedy.match(np.array([[0.9, 0.8], [0.85, 0.1]]), 0.3) == [(0, 0, 0.9)]
    assert greedy.first_match(np.array([[0.5, 0.9]]), 0.4) == [(0, 0)]
    path = [(k, k / 100, 0.0, 0.1, 0.1) for k in range(50)] + [(k, 0.49, (k - 49) / 100, 0.1, 0.1) for k in range(50, 100)]
    assert len(greedy.simplify(path)) <= 6
    near = (0.1, 0.1, 0.1, 0.1)
    chain = greedy.link([(0, 20, near, near), (30, 50, near, near), (30, 50, (0.8, 0.8, 0.1, 0.1), (0.8, 0.8, 0.1, 0.1))], 15, greedy.near_by_gap)
    assert chain == [0, 0, 1]
    assert greedy.suppress(boxes[:2], np.array([0.9, 0.7]), 0.5) == [0]
    assert greedy.cluster_average(np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]]), 0.7) == [0, 0, 1]


def test_confirm(spark):
    rows = [("face", 3, 0.75, 0.2), ("face", 2, 0.95, 0.2), ("face", 5, 0.65, 0.2), ("face", 10, 0.9, 0.75), ("phone", 2, 0.45, 0.1), ("phone", 1, 0.9, 0.1), ("phone", 4, 0.35, 0.1)]
    df = spark.createDataFrame(rows, "label string, hits int, s double, h double")
    assert [r[0] for r in df.select(tracks.confirmed(*map(F.col, ("label", "hits", "s", "h")))).collect()] == [True, False, False, False, True, False, False]


def test_extend_and_split(spark):
    a, b = tracks.extend(F.lit(100), F.lit(120), 15, 15, 130)
    assert tuple(spark.range(1).select(a, b).first()) == (85, 130)
    k = spark.range(100, 201).select(F.col("id").alias("frame"))
    parts = tracks.split_at(k, F.lit(150)).groupBy("part").agg(F.min("frame"), F.max("frame")).orderBy("part").collect()
    assert [tuple(p) for p in parts] == [(0, 100, 149), (1, 150, 200)]


def test_neighbouring_frames_match_over_the_edge_of_a_block(spark):
    rng = np.random.default_rng(9)
    rows = [(k, int(k % 2), "face", int(rng.integers(60, 70)), float(rng.random()), *(float(v) for v in rng.random(2) * 0.3), 0.3, 0.3) for k in range(60)]
    d = spark.createDataFrame(rows, "det_no long, media_id long, label string, frame long, score double, x double, y double, w double, h double")
    want = set()
    for m in range(2):
        for f in range(60, 70):
            old, now = ([r for r in rows if r[1] == m and r[3] == g] for g in (f - 1, f))
            if old and now:
                over = greedy.iou_matrix(np.array([r[5:] for r in old]), np.array([r[5:] for r in now]))
                want |= {(m, f, old[i][0], now[j][0]) for i, j, _ in greedy.match(over, 0.3, np.array([r[4] for r in now]))}
    got = greedy.match_neighbours(d, ["media_id", "label"]).collect()
    assert len(got) == len(want) and {(r.media_id, r.frame, r.before, r.det_no) for r in got} == want
    assert any(f == 64 for _, f, _, _ in want)


def test_chains_are_those_of_a_search_over_all_tails():
    rng = np.random.default_rng(4)
    spans = []
    for s in sorted(int(v) for v in rng.integers(0, 300, 60)):
        box = (*(float(v) for v in rng.random(2) * 0.4), 0.2, 0.2)
        spans.append((s, s + int(rng.integers(1, 30)), box, box))
    spans.sort(key=lambda v: v[:2])
    tails, want = [], []
    for start, end, first, last in spans:
        fits = [(stop, -n) for n, (stop, box) in enumerate(tails) if 0 < start - stop <= 20 and (greedy.iou_of(box, first) >= 0.2 or greedy.near_by_gap(box, first, start - stop, 20))]
        n = -max(fits)[1] if fits else len(tails)
        tails[n:n + 1] = [(end, last)]
        want.append(n)
    assert greedy.link(spans, 20, greedy.near_by_gap) == want
    assert len(set(want)) < len(want)


def test_chunks_go_together_where_they_share_frames():
    key = lambda x, *frames: [(f, x, 0.1, 0.2, 0.2) for f in frames]
    a, b, far = key(0.1, 0, 110), key(0.1, 100, 210), key(0.7, 100, 210)
    assert greedy.merge_chunks([(0, 0, 110, a), (1, 100, 210, b)]) == [0, 0]
    assert greedy.merge_chunks([(0, 0, 110, a), (1, 100, 210, far)]) == [0, 1]
    assert greedy.merge_chunks([(0, 0, 90, key(0.1, 0, 90)), (1, 100, 210, b)]) == [0, 1]
    # One object takes one piece of a chunk, and the first to come has it; a third chunk goes on the second's part.
    near = key(0.12, 100, 210)
    assert greedy.merge_chunks([(0, 0, 110, a), (1, 100, 210, b), (1, 100, 210, near), (2, 200, 300, key(0.1, 200, 300))]) == [0, 0, 1, 0]
    # A moving object is compared where it is, not where it began.
    moving, goes_on = [(0, 0.0, 0.1, 0.2, 0.2), (100, 0.5, 0.1, 0.2, 0.2)], [(90, 0.45, 0.1, 0.2, 0.2), (150, 0.7, 0.1, 0.2, 0.2)]
    assert greedy.merge_chunks([(1, 90, 150, goes_on), (0, 0, 100, moving)]) == [0, 0]
    assert greedy.merge_chunks([]) == []


def test_merged_chunks_as_a_table(spark):
    rows = [(1, "face", c, p, s, e, [(f, x, 0.1, 0.2, 0.2) for f in (s, e)]) for c, p, s, e, x in ((0, 1, 0, 110, 0.1), (0, 2, 0, 110, 0.6), (1, 3, 100, 200, 0.62), (1, 4, 100, 200, 0.12))]
    schema = "media_id long, label string, chunk long, piece long, start_frame long, end_frame long, keys array<struct<frame:long,x:double,y:double,w:double,h:double>>"
    got = {r.piece: r.object for r in tracks.merge_chunks(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == got[4] != got[2] == got[3]
    assert tracks.merge_chunks(spark.createDataFrame([], schema)).count() == 0
