"""Operators over tracks, spans and keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, near
from tessera.operators import greedy
from tessera.operators.intervals import overlap_join


def extent(spans: DataFrame) -> DataFrame:
    return spans.groupBy("media_id", "track_id", "label").agg(F.min("start_frame").alias("first_frame"), F.max("end_frame").alias("last_frame"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("total_frames"), F.count("*").alias("n_spans"))


def confirmed(label: Column, hits: Column, mean_score: Column, median_h: Column, least_face_score: float = 0.7, fallback_only: Column | None = None) -> Column:
    """Enough hits, a good mean score and a plausible height; a track of fallback boxes alone needs more than one."""
    face = label.isin("face", "head")
    rule = F.when(face, (median_h <= 0.6) & (hits >= 3) & (mean_score >= least_face_score)).otherwise((hits >= 2) & (mean_score >= 0.4))
    return rule if fallback_only is None else rule & ~(fallback_only & (hits <= 1))


def confirm(keys: DataFrame, least_face_score: float = 0.7) -> DataFrame:
    t = keys.groupBy("media_id", "track_id", "label").agg(F.count("*").alias("hits"), F.round(F.avg("score"), 6).alias("mean_score"), F.percentile("h", 0.5).alias("median_h"))
    return t.withColumn("confirmed", confirmed(F.col("label"), F.col("hits"), F.col("mean_score"), F.col("median_h"), least_face_score))


def covisible(spans: DataFrame) -> DataFrame:
    a = spans.select("media_id", F.col("track_id").alias("a"), F.col("start_frame").alias("a0"), F.col("end_frame").alias("a1"))
    b = spans.select("media_id", F.col("track_id").alias("b"), F.col("start_frame").alias("b0"), F.col("end_frame").alias("b1"))
    return overlap_join(a, b, ["media_id"], 256, ("a0", "a1"), ("b0", "b1")).where("a < b").groupBy("a", "b").agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0") + 1).alias("frames"))


def with_end_boxes(spans: DataFrame, keys: DataFrame) -> DataFrame:
    """Spans with their first (f_) and last (l_) box."""
    box = keys.select("track_id", "frame", *Box.of().columns())
    first = box.select("track_id", F.col("frame").alias("start_frame"), *Box.of().columns("f_"))
    last = box.select("track_id", F.col("frame").alias("end_frame"), *Box.of().columns("l_"))
    return spans.join(first, ["track_id", "start_frame"]).join(last, ["track_id", "end_frame"])


def bridge(spans: DataFrame, keys: DataFrame, most_gap: int, reach: float = 1.5) -> DataFrame:
    """Neighbouring spans of a track as one where the gap is short and the boxes at its ends are near."""
    w = W.partitionBy("media_id", "track_id").orderBy("start_frame")
    e = with_end_boxes(spans, keys)
    before = e.select("*", F.lag("end_frame").over(w).alias("p_end"), *[F.lag(f"l_{c}").over(w).alias(f"p_{c}") for c in "xywh"])
    gap = F.col("start_frame") - F.col("p_end")
    joins = F.coalesce((gap > 0) & (gap <= most_gap) & near(Box.of("p_"), Box.of("f_"), reach), F.lit(False))
    runs = before.withColumn("new", (~joins).cast("long")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("media_id", "track_id", "run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("n_spans")).drop("run")


def link_fragments(spans: DataFrame, keys: DataFrame, most_gap: int) -> DataFrame:
    """Chain number of every span of a medium's label, taken in order of their starts."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["start_frame", "track_id", "span_no"])
        rows = [(int(r.start_frame), int(r.end_frame), (r.f_x, r.f_y, r.f_w, r.f_h), (r.l_x, r.l_y, r.l_w, r.l_h)) for r in pdf.itertuples()]
        return pd.DataFrame({"media_id": pdf["media_id"], "label": pdf["label"], "track_id": pdf["track_id"], "span_no": pdf["span_no"], "chain": greedy.link(rows, most_gap, greedy.near_by_gap)})

    return with_end_boxes(spans, keys).groupBy("media_id", "label").applyInPandas(run, "media_id long, label string, track_id long, span_no long, chain int")


def merge_chunks(pieces: DataFrame, least: float = 0.3) -> DataFrame:
    """(media_id, label, chunk, piece, object) of tracks that were found chunk by chunk, each with some frames of the next.

    ``pieces`` are (media_id, label, chunk, piece, start_frame, end_frame, keys); a medium's label is a group, which a recording bounds.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["chunk", "start_frame", "piece"])
        rows = [(int(r.chunk), int(r.start_frame), int(r.end_frame), sorted((int(k["frame"]), *(float(k[c]) for c in "xywh")) for k in r.keys)) for r in pdf.itertuples()]
        return pd.DataFrame({"media_id": pdf["media_id"], "label": pdf["label"], "chunk": pdf["chunk"], "piece": pdf["piece"], "object": greedy.merge_chunks(rows, least)})

    return pieces.groupBy("media_id", "label").applyInPandas(run, "media_id long, label string, chunk long, piece long, object int")


def simplify_keys(keys: DataFrame, tolerance: float = 0.004) -> DataFrame:
    def run(pdf):
        import pandas as pd

        rows = sorted(pdf[["frame", "x", "y", "w", "h"]].itertuples(index=False, name=None))
        return pd.DataFrame([(int(pdf["track_id"].iloc[0]), *r) for r in greedy.simplify(rows, tolerance)], columns=["track_id", "frame", "x", "y", "w", "h"])

    return keys.groupBy("track_id").applyInPandas(run, "track_id long, frame long, x double, y double, w double, h double")


def split_at(keys: DataFrame, frame: Column) -> DataFrame:
    """Keyframes with ``part`` 0 before the frame and 1 from it on."""
    return keys.withColumn("part", F.when(F.col("frame") < frame, 0).otherwise(1))


def apply_edit(keys: DataFrame, frame: int, scope: str, dx: float, dy: float, sw: float, sh: float) -> DataFrame:
    """Boxes within ``scope`` (frame, onward, back, track) shifted by (dx, dy) and scaled about their centres, clamped."""
    hit = {"frame": F.col("frame") == frame, "onward": F.col("frame") >= frame, "back": F.col("frame") <= frame, "track": F.lit(True)}[scope]
    x = F.greatest(F.least(F.col("x") + F.col("w") / 2 + dx - F.col("w") * sw / 2, F.lit(1.0)), F.lit(0.0))
    y = F.greatest(F.least(F.col("y") + F.col("h") / 2 + dy - F.col("h") * sh / 2, F.lit(1.0)), F.lit(0.0))
    w, h = F.least(F.col("w") * sw, 1 - x), F.least(F.col("h") * sh, 1 - y)
    return keys.select(*[c for c in keys.columns if c not in "xywh"], *[F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in zip("xywh", (x, y, w, h), strict=True)])


def extend(start: Column, end: Column, lead: int, lag: int, last: int) -> tuple[Column, Column]:
    """A span with ``lead`` frames before and ``lag`` after it, inside the medium."""
    return F.greatest(start - lead, F.lit(0)), F.least(end + lag, F.lit(last))


def flags(source: Column, label: Column, note: Column, frames: Column, fps: float) -> Column:
    """Array of the reasons to review a track."""
    auto = source.startswith("auto")
    confidence = F.nullif(F.regexp_extract(note, r"avg conf ([0-9.]+)", 1), F.lit("")).try_cast("double")
    found = [
        F.when(auto & (frames < fps), "short"), F.when(auto & note.contains("single detection"), "single"), F.when(auto & (confidence < 0.6), "low-conf"),
        F.when(auto & ((label == "head") | note.contains("head-fallback")), "head-fallback"), F.when(auto & (note.contains("linked") | note.contains("merged")), "linked"),
        F.when(note.startswith("tracking cancelled"), "incomplete"),
    ]
    return F.array_compact(F.array(*found))


def report(spans: DataFrame, fps: float, default_style: str) -> DataFrame:
    return spans.select(F.lit("video").alias("kind"), "media_id", "track_id", "label", "span_no", F.round(F.col("start_frame") / fps, 3).alias("start_s"), F.round((F.col("end_frame") + 1) / fps, 3).alias("end_s"), F.coalesce("style", F.lit(default_style)).alias("style"))


def variable_rate(stamps: DataFrame, by: str, at: str) -> DataFrame:
    """(by, n, median_ms, irregular, vfr) of time stamps in milliseconds."""
    gap = stamps.withColumn("gap", F.col(at) - F.lag(at).over(W.partitionBy(by).orderBy(at))).where("gap > 0")
    mid = gap.groupBy(by).agg(F.percentile("gap", 0.5).alias("median_ms"), F.count("*").alias("n"))
    odd = (F.abs(F.col("gap") - F.col("median_ms")) > 0.2 * F.col("median_ms")).cast("double")
    return gap.join(mid, by).groupBy(by, "n", "median_ms").agg(F.round(F.avg(odd), 6).alias("irregular"), (F.avg(odd) > 0.02).alias("some")).select(by, "n", "median_ms", "irregular", ((F.col("n") >= 8) & F.col("some")).alias("vfr"))
