"""Figures of accuracy: what redactions cover and how much of them is needed, how a tracked case went, what a clip's run took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.geometry import Box
from tessera.operators.intervals import interpolate, merge_spans

FRAME = ["media_id", "frame"]
COVERS = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def share_under(boxes: DataFrame, over: DataFrame, n: int) -> DataFrame:
    """``boxes`` with ``covered``: the share of each under the boxes of ``over`` on its frame, by the centres of n x n cells."""
    edge = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    covers = over.groupBy(*FRAME).agg(F.collect_list(edge).alias("covers_"))  # a frame's boxes are few
    both = boxes.join(covers, FRAME, "left").withColumn("covers_", F.coalesce("covers_", F.array().cast(COVERS)))
    return both.withColumn("covered", g.covered_share(Box.of(), F.col("covers_"), n)).drop("covers_")


def accuracy_report(truth: DataFrame, redactions: DataFrame, frames: DataFrame, n: int = 6, enough: float = 0.9, hit: float = 0.5) -> DataFrame:
    """By label and for ``all``: true boxes, how many are covered, recall; redactions, how many lie on true boxes, precision; frames
    with a leak and their share of ``frames``, the labelled (media_id, frame)."""
    t = share_under(truth, redactions, n).select(*FRAME, "label", F.lit(1).alias("gt"), (F.col("covered") >= enough).cast("int").alias("safe"), F.lit(0).alias("pred"), F.lit(0).alias("on"))
    r = share_under(redactions, truth, n).select(*FRAME, "label", F.lit(0).alias("gt"), F.lit(0).alias("safe"), F.lit(1).alias("pred"), (F.col("covered") >= hit).cast("int").alias("on"))
    leak = F.countDistinct(F.when((F.col("gt") == 1) & (F.col("safe") == 0), F.struct(*FRAME)))
    by = t.unionByName(r).rollup("label").agg(*[F.sum(c).alias(c) for c in ("gt", "safe", "pred", "on")], leak.alias("leak_frames"))
    all_ = frames.select(*FRAME).distinct().agg(F.count("*").alias("n_"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    got = by.join(F.broadcast(all_))  # one row
    return got.select(F.coalesce("label", F.lit("all")).alias("label"), "gt", "safe", share("safe", "gt").alias("recall"), "pred", "on", share("on", "pred").alias("precision"), "leak_frames", share("leak_frames", "n_").alias("leak_rate"))


def case_metrics(cases: DataFrame, tracked: DataFrame, keys: DataFrame, dets: DataFrame, overlap: float = 0.3, every: int = 10) -> DataFrame:
    """How the tracking of each case (case_id, media_id, label, start_frame, end_frame) went.

    ``tracked`` (case_id, start_frame, end_frame) are the spans that came out and ``keys`` (case_id, frame, box) their keyframes.
    ``covered`` frames of the case and their share, ``tracked`` frames in all, ``overrun`` frames outside the case; of every tenth of
    these, ``checked`` ones with a box and ``unsupported`` ones whose box meets no detection of the label.  Frames are counted by
    the ends of spans; only each tenth overrun frame becomes a row.
    """
    s = merge_spans(tracked.select("case_id", "start_frame", "end_frame"), ["case_id"]).select("case_id", F.col("start_frame").alias("s0"), F.col("end_frame").alias("s1"))
    c = cases.select("case_id", "media_id", "label", "start_frame", "end_frame").join(s, "case_id", "left")
    length = lambda a, b: F.greatest(F.coalesce(b - a + 1, F.lit(0)), F.lit(0)).cast("long")
    inside = length(F.greatest("s0", "start_frame"), F.least("s1", "end_frame"))
    known = c.withColumns({"in_": F.when(F.col("s0").isNull(), 0).otherwise(inside), "long_": length(F.col("s0"), F.col("s1"))})
    sums = known.groupBy("case_id", "media_id", "label", "start_frame", "end_frame").agg(F.sum("in_").alias("covered"), F.sum("long_").alias("tracked"), F.count("s0").alias("spans"))
    # The pieces outside the case, with the number of overrun frames before each.
    piece = F.explode(F.array(F.struct(F.col("s0").alias("a"), F.least(F.col("s1"), F.col("start_frame") - 1).alias("b")), F.struct(F.greatest(F.col("s0"), F.col("end_frame") + 1).alias("a"), F.col("s1").alias("b"))))
    out = c.where("s0 is not null").select("case_id", "media_id", "label", piece.alias("p")).select("case_id", "media_id", "label", "p.*").where("b >= a")
    before = F.coalesce(F.sum(F.col("b") - F.col("a") + 1).over(W.partitionBy("case_id").orderBy("a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = out.withColumn("first", F.col("a") + F.pmod(-before, F.lit(every))).where("first <= b")
    asked = first.select("case_id", "media_id", "label", F.explode(F.sequence("first", "b", F.lit(every).cast("long"))).alias("frame"))
    boxes = interpolate(asked.select("case_id", "frame"), keys, ["case_id"]).join(asked, ["case_id", "frame"])
    seen = dets.select(*FRAME, "label", *Box.of().columns("d_"))
    met = boxes.join(seen, [*FRAME, "label"]).where(g.iou(Box.of(), Box.of("d_")) >= overlap).select("case_id", "frame").distinct().withColumn("met", F.lit(1))
    told = boxes.join(met, ["case_id", "frame"], "left").groupBy("case_id").agg(F.count("*").alias("checked"), F.count(F.when(F.col("met").isNull(), 1)).alias("unsupported"))
    n = F.col("end_frame") - F.col("start_frame") + 1
    zero = lambda v: F.coalesce(v, F.lit(0).cast("long"))
    return sums.join(told, "case_id", "left").select(
        "case_id", "media_id", "label", n.alias("frames"), "covered", F.round(F.col("covered") / n, 3).alias("coverage"), "tracked", "spans",
        (F.col("tracked") - F.col("covered")).alias("overrun"), zero("checked").alias("checked"), zero("unsupported").alias("unsupported"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """``case_metrics`` by label; ``full`` counts the cases covered by nine tenths."""
    return metrics.groupBy("label").agg(
        F.count("*").alias("cases"), F.round(F.sum("covered") / F.greatest(F.sum("frames"), F.lit(1)), 3).alias("coverage"), F.count(F.when(F.col("coverage") >= 0.9, 1)).alias("full"),
        *[F.sum(c).alias(c) for c in ("spans", "overrun", "checked", "unsupported")],
    )


def configurations(reference: DataFrame, results: DataFrame, extents: DataFrame, n: int = 6, enough: float = 0.6) -> DataFrame:
    """(config, reference_boxes, covered, share, heads, frames) of the boxes and tracks that each configuration gave.

    ``results`` (config, media_id, frame, box) are laid over the same reference boxes; ``extents`` (config, label, total_frames).
    """
    edge = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    covers = results.groupBy("config", *FRAME).agg(F.collect_list(edge).alias("covers"))  # a frame's boxes are few
    hit = reference.join(covers, FRAME).where(g.covered_share(Box.of(), F.col("covers"), n) >= enough).groupBy("config").agg(F.count("*").alias("covered"))
    total = reference.agg(F.count("*").alias("reference_boxes"))
    told = extents.groupBy("config").agg(F.count(F.when(F.col("label") == "head", 1)).alias("heads"), F.sum("total_frames").alias("frames"))
    got = told.join(hit, "config", "left").join(F.broadcast(total))  # one row
    covered = F.coalesce("covered", F.lit(0).cast("long"))
    return got.select("config", "reference_boxes", covered.alias("covered"), F.round(covered / F.greatest("reference_boxes", F.lit(1)), 6).alias("share"), "heads", "frames")


def timing(stages: DataFrame, clips: DataFrame) -> DataFrame:
    """(media_id, stage, seconds, share) of stage times (media_id, stage, seconds) within a clip (media_id, frames, seconds), with
    the ``other`` seconds that no stage took, and ``fps``."""
    each = stages.groupBy("media_id", "stage").agg(F.sum("seconds").alias("seconds"))
    total = clips.select("media_id", F.col("frames").alias("n"), F.col("seconds").alias("all_"))
    left = total.join(each.groupBy("media_id").agg(F.sum("seconds").alias("known")), "media_id", "left")
    other = left.select("media_id", F.lit("other").alias("stage"), F.greatest(F.col("all_") - F.coalesce("known", F.lit(0.0)), F.lit(0.0)).alias("seconds"))
    got = each.unionByName(other).join(total, "media_id")
    per = lambda v, by, places: F.round(F.when(by > 0, v / by), places)
    return got.select("media_id", "stage", F.round("seconds", 3).alias("seconds"), per(F.col("seconds"), F.col("all_"), 4).alias("share"), per(F.col("n"), F.col("all_"), 1).alias("fps"))


def verify_totals(found: DataFrame, frames: DataFrame, fps: float, least: float) -> DataFrame:
    """One row over detections with their ``covered`` share: frames checked, detections, uncovered ones, the first such second."""
    open_: Column = F.col("covered") < least
    d = found.agg(F.count("*").alias("detections"), F.count(F.when(open_, 1)).alias("uncovered"), F.round(F.min(F.when(open_, F.col("frame"))) / fps, 3).alias("first_s"))
    return d.join(F.broadcast(frames.select(*FRAME).distinct().agg(F.count("*").alias("checked")))).select("checked", "detections", "uncovered", "first_s")  # one row each
