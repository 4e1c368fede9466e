"""Tables as files: report and verification rows, project documents, label lines, annotation tasks, hashed manifests.

Rows are formed by expressions and written by Spark's committers, so a lost task leaves no half file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def verification_rows(uncovered: DataFrame, decimals: int = 3) -> DataFrame:
    """Fractions as text with fixed decimals; other columns as they are."""
    return uncovered.select(*[F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in uncovered.dtypes])


def label_lines(boxes: DataFrame, frames: DataFrame, classes: list[str]) -> DataFrame:
    """(media_id, frame, text): a label file's text per labelled frame; boxes of unlisted classes take the next numbers."""
    known = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>")
    extra = boxes.where(~F.array_contains(known, F.col("cls"))).select("cls").distinct()
    extra = extra.withColumn("after", F.row_number().over(W.orderBy("cls")) + len(classes))  # names of classes, a handful
    numbered = boxes.join(extra, "cls", "left").withColumn("n", F.coalesce("after", F.array_position(known, F.col("cls"))) - 1)
    six = lambda c: F.bround(c, 6)  # ties to even, as other writers of this format do
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "n", six(F.col("x") + F.col("w") / 2), six(F.col("y") + F.col("h") / 2), six("w"), six("h"))
    per = numbered.groupBy("media_id", "frame").agg(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")).alias("text"))
    return frames.select("media_id", "frame").distinct().join(per, ["media_id", "frame"], "left").select("media_id", "frame", F.coalesce("text", F.lit("")).alias("text"))


def annotation_tasks(frames: DataFrame, dets: DataFrame, model_version: str, root: str = "") -> DataFrame:
    """(image, task): an annotation task as JSON per frame of (media_id, frame, image, width, height), with the frame's
    detections as predictions in per cent; a frame without any has an empty list."""
    value = F.struct(*[(F.col(c) * 100).alias(n) for c, n in zip("xywh", ("x", "y", "width", "height"), strict=True)], F.lit(0).alias("rotation"), F.array("label").alias("rectanglelabels"))
    one = F.struct(F.lit("box").alias("from_name"), F.lit("image").alias("to_name"), F.lit("rectanglelabels").alias("type"), F.col("width").alias("original_width"), F.col("height").alias("original_height"), value.alias("value"), F.round("score", 3).alias("score"))
    joined = frames.join(dets.select("media_id", "frame", "label", "score", *"xywh"), ["media_id", "frame"], "left")
    per = joined.groupBy("media_id", "frame", "image").agg(F.collect_list(F.when(F.col("label").isNotNull(), one)).alias("result"))
    result = F.array_sort("result", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    predictions = F.array(F.struct(F.lit(model_version).alias("model_version"), result.alias("result")))
    return per.select("image", F.to_json(F.struct(F.struct(F.concat(F.lit(root), "image").alias("image")).alias("data"), predictions.alias("predictions"))).alias("task"))


def track_documents(nested: DataFrame) -> DataFrame:
    """(media_id, document): a medium's tracks as a JSON list, keyframes as a map from frame to [x, y, w, h]."""
    keyframes = F.map_from_entries(F.transform("keys", lambda k: F.struct(k["frame"].cast("string"), F.array(*[k[c] for c in "xywh"]))))
    span = F.struct("start_frame", "end_frame", keyframes.alias("keyframes"))
    about = [c for c in ("label", "style", "shape", "pad", "source", "enabled", "created_at", "created_by", "note") if c in nested.columns]
    # Maps can't be sorted, so spans are sorted by their frames with their place in the list.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", F.to_json(span).alias("span")))), lambda s: s["span"])
    per = nested.groupBy("media_id", "track_id").agg(ordered.alias("spans"), *[F.first(c, ignorenulls=True).alias(c) for c in about])
    head = F.to_json(F.struct(F.col("track_id").alias("id"), *about))
    track = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "spans": ['), F.array_join("spans", ", "), F.lit("]}"))
    return per.groupBy("media_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(track)), ", "), F.lit("]")).alias("document"))


def canonical(body: dict[str, Column]) -> Column:
    """JSON with the names in order and nulls kept, so that equal content has equal bytes."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(body.items())]), {"ignoreNullFields": "false"})


def sealed(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with ``manifest_sha256`` over the canonical JSON of ``fields``."""
    return df.withColumn("manifest_sha256", F.sha2(canonical({f: F.col(f) for f in fields}), 256))


def verified(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with ``intact``: does the hash that it carries fit its fields."""
    return df.withColumn("intact", F.coalesce(F.col("manifest_sha256") == F.sha2(canonical({f: F.col(f) for f in fields}), 256), F.lit(False)))
