"""What the accuracy benches ask of tracks and detections, and rules that act on whole tracks or redactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, iou
from tessera.operators import greedy
from tessera.operators.edits import box_at, nest
from tessera.operators.intervals import overlap_join

JOIN_GAP_S = 10.0
STRUCTURAL_TAGS = ("major_brand", "minor_version", "compatible_brands", "handler_name", "vendor_id", "encoder", "language")  # fixed values
RETIRED_STYLES = ("pixelate",)


def tracking_cases(spans: DataFrame, keys: DataFrame, least_frames: int, most: int) -> DataFrame:
    """The middle keyframe of each long enough span, ``most`` per medium: evenly spaced in the order of box heights.

    Each span counts as a track of its own.  A medium bounds the window.
    """
    n = nest(spans.where(F.col("end_frame") - F.col("start_frame") + 1 >= least_frames), keys).where("size(keys) > 0")
    mid = F.element_at("keys", (F.floor(F.size("keys") / 2) + 1).cast("int"))
    w = W.partitionBy("media_id")
    ranked = n.withColumn("m", mid).withColumn("i", F.row_number().over(w.orderBy("m.h", "track_id", "span_no")) - 1).withColumn("n", F.count("*").over(w))
    nth = F.ceil(F.col("i") * most / F.col("n"))
    taken = ranked.where((F.col("n") <= most) | ((nth < most) & (F.floor(nth * F.col("n") / most) == F.col("i"))))
    return taken.select("media_id", "track_id", "span_no", "start_frame", "end_frame", F.col("m.frame").alias("mid"), F.col("m.h").alias("h"))


def retrack_seeds(spans: DataFrame, keys: DataFrame) -> DataFrame:
    """The box in the middle of each track's longest span (the first of equals)."""
    best = F.max_by(F.struct("start_frame", "end_frame", "keys"), F.struct(F.col("end_frame") - F.col("start_frame"), -F.col("start_frame")))
    s = nest(spans, keys).groupBy("media_id", "track_id").agg(best.alias("s")).withColumn("mid", F.floor((F.col("s.start_frame") + F.col("s.end_frame")) / 2))
    b = s.withColumn("b", box_at(F.col("s.keys"), F.col("mid"))).where("b is not null")
    return b.select("media_id", "track_id", "mid", *[F.col(f"b.{c}").alias(c) for c in "xywh"])


def near_key_match(dets: DataFrame, spans: DataFrame, keys: DataFrame, least: float = 0.3) -> DataFrame:
    """Detections and the spans on their frame whose nearest keyframe (the earlier of equals) overlaps them enough."""
    s = nest(spans, keys).where("size(keys) > 0").select("media_id", "track_id", "span_no", "start_frame", "end_frame", "keys")
    d = dets.select("media_id", "det_no", "frame", F.col("frame").alias("frame2"), *Box.of().columns())
    met = overlap_join(d, s, ["media_id"], 128, ("frame", "frame2"), ("start_frame", "end_frame"))
    nearest = F.array_min(F.transform("keys", lambda k: F.struct(F.abs(k["frame"] - F.col("frame")).alias("away"), k["frame"].alias("frame"), *[k[c].alias(c) for c in "xywh"])))
    k = met.withColumn("k", nearest)
    return k.where(iou(Box.of(), Box(*(F.col(f"k.{c}") for c in "xywh"))) >= least).select("det_no", "track_id", "span_no", F.col("k.frame").alias("key_frame"))


def aligned(a: DataFrame, b: DataFrame, every: float, fps_a: float, fps_b: float, offset: float) -> DataFrame:
    """Rows (media_id, frame, n) of two streams paired by the instants k * every; the second runs ``offset`` seconds late.

    Each side computes the frame of an instant, so the pairing is an equi-join on it.
    """
    last = a.groupBy("media_id").agg((F.floor(F.max("frame") / fps_a / every)).alias("last"))
    k = last.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k"))
    at = k.select("media_id", "k", F.rint(F.col("k") * every * fps_a).cast("long").alias("frame_a"), F.rint((F.col("k") * every + offset) * fps_b).cast("long").alias("frame_b"))
    side = lambda df, s: df.select("media_id", F.col("frame").alias(f"frame_{s}"), F.col("n").alias(f"n_{s}"))
    return at.join(side(a, "a"), ["media_id", "frame_a"]).join(side(b, "b"), ["media_id", "frame_b"]).select("media_id", "k", "frame_a", "frame_b", "n_a", "n_b")


def best_offset(a: DataFrame, b: DataFrame, reach: int = 10) -> DataFrame:
    """(media_id, offset): the shift of ``b`` (media_id, frame, v) with the least summed difference from ``a``'s values."""
    asked = a.select("media_id", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k"), F.col("frame"), F.col("v").alias("va")).withColumn("frame", F.col("frame") + F.col("k"))
    total = asked.join(b, ["media_id", "frame"]).groupBy("media_id", "k").agg(F.sum(F.abs(F.col("va") - F.col("v"))).alias("off"))
    return total.groupBy("media_id").agg(F.min_by("k", F.struct("off", "k")).alias("offset"))


def _frames(dets: DataFrame, by: list[str], schema: str, each) -> DataFrame:
    """``each`` over the detections of a frame (or of what ``by`` says) in the order of det_no."""
    return greedy.by_frames(dets, by, schema, lambda pdf: each(pdf.reset_index(drop=True)))


def compared(dets: DataFrame, least: float = 0.4) -> DataFrame:
    """Per medium and label: boxes that ``side`` a and b both found, that b gained, and that a had and b lost.

    Each box of a takes the best free box of b on its frame that overlaps it by more than ``least``.
    """

    def each(pdf):
        a, b = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"]
        over = greedy.iou_matrix(a[list("xywh")].to_numpy(float), b[list("xywh")].to_numpy(float))
        free, both = [True] * len(b), 0
        for row in over:
            fit = [(v, -j) for j, v in enumerate(row) if free[j] and v > least]
            if fit:
                free[-max(fit)[1]] = False
                both += 1
        return [(int(pdf["media_id"].iloc[0]), pdf["label"].iloc[0], both, len(b) - both, len(a) - both)]

    found = _frames(dets, ["media_id", "frame", "label"], "media_id long, label string, both long, gained long, lost long", each)
    return found.groupBy("media_id", "label").agg(*[F.sum(c).alias(c) for c in ("both", "gained", "lost")])


def consensus(dets: DataFrame, agree: int = 2, least: float = 0.4) -> DataFrame:
    """Boxes that at least ``agree`` sources found: each free box in turn gathers the free later ones that overlap it."""

    def each(pdf):
        pdf = pdf.sort_values(["source", "det_no"], ignore_index=True)
        over = greedy.iou_matrix(pdf[list("xywh")].to_numpy(float), pdf[list("xywh")].to_numpy(float))
        used, out = set(), []
        for i in range(len(pdf)):
            if i in used:
                continue
            group = [i] + [j for j in range(i + 1, len(pdf)) if j not in used and over[i, j] >= least]
            used.update(group)
            n = pdf["source"].iloc[group].nunique()
            if n >= agree:
                out.append((int(pdf["media_id"].iloc[0]), int(pdf["frame"].iloc[0]), int(pdf["det_no"].iloc[i]), *map(float, pdf.loc[i, list("xywh")]), n))
        return out

    return _frames(dets, ["media_id", "frame"], "media_id long, frame long, det_no long, x double, y double, w double, h double, n_sources int", each)


def source_scores(dets: DataFrame, least: float = 0.4) -> DataFrame:
    """Per source: tp, fp, fn against the rows with ``truth``; each box takes the first free true box that overlaps enough."""

    def each(pdf):
        true = pdf[pdf["truth"]][list("xywh")].to_numpy(float)
        out = []
        for s, p in pdf[~pdf["truth"]].groupby("source"):
            n = len(greedy.first_match(greedy.iou_matrix(p[list("xywh")].to_numpy(float), true), least))
            out.append((s, n, len(p) - n, len(true)))
        return out

    hits = _frames(dets, ["media_id", "frame"], "source string, tp long, fp long, seen long", each)
    everything = dets.where("truth").agg(F.count("*").alias("n_true"))
    by = hits.groupBy("source").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return by.join(F.broadcast(everything)).select("source", "tp", "fp", (F.col("n_true") - F.col("tp")).alias("fn"))  # one row


def join_targets(drawn: DataFrame, spans: DataFrame, keys: DataFrame, fps: float, most_s: float = JOIN_GAP_S) -> DataFrame:
    """Which drawn box (with the track_id selected for it) continues its track.

    The box lies in a gap of the track, within ``most_s`` of the nearest span's edge (the earlier span of equals), and its
    size is within a factor of three of the box at that edge.  A track's spans bound the array.
    """
    edge = lambda end: box_at(F.col("keys"), F.col(end))
    each = F.struct("start_frame", "end_frame", edge("start_frame").alias("first"), edge("end_frame").alias("last"))
    of = nest(spans, keys).where("size(keys) > 0").groupBy("media_id", "track_id").agg(F.array_sort(F.collect_list(each)).alias("spans"))
    met = drawn.join(of, ["media_id", "track_id"])
    f = F.col("frame")
    away = F.transform("spans", lambda s: F.struct(
        F.when(s["end_frame"] < f, f - s["end_frame"]).when(s["start_frame"] > f, s["start_frame"] - f).otherwise(F.lit(0)).alias("gap"),
        s["start_frame"].alias("at"), F.when(s["end_frame"] < f, F.greatest(s["last"]["w"], s["last"]["h"])).otherwise(F.greatest(s["first"]["w"], s["first"]["h"])).alias("size")))
    size = F.greatest("w", "h")
    n = met.withColumn("near", F.array_min(away)).where((F.col("near.gap") > 0) & (F.col("near.gap") <= most_s * fps))
    return n.where((size > 0) & (F.col("near.size") > 0) & (size <= 3 * F.col("near.size")) & (F.col("near.size") <= 3 * size)).select("det_no", "track_id", F.col("near.gap").alias("gap"))


def still_open(hits: DataFrame, words: DataFrame, ranges: DataFrame, bin_s: float = 8.0) -> DataFrame:
    """Hits (media_id, i0, i1, ...) that hold a word whose midpoint no range [start_s, end_s) covers."""
    mid = words.select("media_id", "idx", ((F.col("start_s") + F.col("end_s")) / 2).alias("mid")).withColumn("mid2", F.col("mid"))
    r = ranges.select("media_id", F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s"))
    hidden = overlap_join(mid, r, ["media_id"], bin_s, ("mid", "mid2"), ("from_s", "to_s")).where("mid < to_s").select("media_id", "idx").distinct()
    spread = hits.select("media_id", "i0", "i1", F.explode(F.sequence("i0", "i1")).alias("idx"))
    bare = spread.join(hidden, ["media_id", "idx"], "left_anti").select("media_id", "i0", "i1").distinct()
    return hits.join(bare, ["media_id", "i0", "i1"], "left_semi")


def unredact(ranges: DataFrame, spoken: DataFrame, bin_s: float = 8.0) -> DataFrame:
    """Ranges without those that overlap (open intervals) what is to be heard again: (media_id, from_s, to_s)."""
    tagged = ranges.withColumn("rid", F.struct("media_id", "style", "start_s", "end_s"))
    gone = overlap_join(tagged, spoken, ["media_id"], bin_s, ("start_s", "end_s"), ("from_s", "to_s"), closed=False).select("rid").distinct()
    return tagged.join(gone, "rid", "left_anti").drop("rid")


def tags_carried(source: DataFrame, output: DataFrame) -> DataFrame:
    """Tags (file, section, key, value) of the source whose value is anywhere in the same file's output."""
    asked = source.where(~F.col("key").isin(*STRUCTURAL_TAGS) & (F.length("value") >= 3))
    return asked.join(output.where("value <> ''").select("file", "value").distinct(), ["file", "value"], "left_semi").select("file", F.concat_ws(".", "section", "key").alias("tag")).distinct()


def same_person(tracks: DataFrame, matches: DataFrame, subject: int, action: str) -> DataFrame:
    """Tracks after ``action`` on the matched ones (media_id, track_id): disable, delete, or keep only this person's faces."""
    hit = tracks.join(matches.select("media_id", "track_id").distinct().withColumn("hit", F.lit(True)), ["media_id", "track_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if action == "delete":
        return hit.where(~F.col("hit")).drop("hit")
    if action == "disable":
        return hit.withColumn("enabled", F.col("enabled") & ~F.col("hit")).drop("hit")
    if action != "only":
        raise ValueError(f"no such action: {action}")
    other = (F.col("label") == "face") & (F.col("track_id") != subject)
    return hit.withColumn("enabled", F.when(F.col("hit"), True).when(other, False).otherwise(F.col("enabled"))).drop("hit")


def retire_styles(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks with retired styles made black, and one log row (media_id, action, details) per medium that had any."""
    old = F.coalesce(F.col("style").isin(*RETIRED_STYLES), F.lit(False))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_id", "label", "style"))), lambda t: F.concat_ws(" ", t["label"], t["track_id"].cast("string"), t["style"])), "; ")
    log = tracks.where(old).groupBy("media_id").agg(F.lit("video_style_retired").alias("action"), said.alias("details"))
    return tracks.withColumn("style", F.when(old, "black").otherwise(F.col("style"))), log
