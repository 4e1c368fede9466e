"""Files as tables: project documents, label files, annotation exports, media tags, settings.

Every reader parses on the executors, a file a row.  A file of project, annotation or tag text is read whole, as its writers
make one per medium or task list.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, clamp

VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "avi", "wmv", "m4v", "mpg", "mpeg", "webm", "3gp", "ts", "mts", "m2ts", "flv", "asf")
AUDIO_SUFFIXES = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "wma", "opus", "amr", "aif", "aiff")

BOXES = "array<double>"
SPAN = f"start_frame: bigint, end_frame: bigint, keyframes: map<string, {BOXES}>"
TRACK = f"id: string, label: string, style: string, shape: string, pad: double, source: string, enabled: boolean, created_at: string, created_by: string, note: string, spans: array<struct<{SPAN}>>"
PROJECT = f"""format string, version int, media struct<path: string, duration: double, has_video: boolean, has_audio: boolean, width: int, height: int, fps: double, frame_count: bigint, sample_rate: int, channels: int, sha256: string>,
 audio_redactions array<struct<id: string, start: double, end: double, text: string, reason: string, style: string, source: string, enabled: boolean>>,
 video_tracks array<struct<{TRACK}>>, transcript array<struct<start: double, end: double, text: string, words: array<struct<start: double, end: double, text: string, confidence: double>>>>, transcript_model string, default_audio_style string, default_video_style string, author string, case_number string, notes string"""


def whole(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of every file under ``path``."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def media_kind(path: Column) -> Column:
    """video, audio or null, by the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin(*VIDEO_SUFFIXES), "video").when(suffix.isin(*AUDIO_SUFFIXES), "audio")


def projects(spark: SparkSession, path: str, project_format: str, glob: str = "*") -> DataFrame:
    """Project documents, parsed; a file that is none of ``project_format`` has ``error`` instead of fields."""
    return parsed_projects(whole(spark, path, glob), project_format)


def parsed_projects(texts: DataFrame, project_format: str) -> DataFrame:
    """The same of documents (path, text) at hand."""
    p = texts.withColumn("p", F.from_json("text", PROJECT))
    good = F.coalesce(F.col("p.format") == project_format, F.lit(False))
    return p.select("path", F.when(good, F.col("p")).alias("p"), F.when(~good, F.lit("not a project file")).alias("error")).select("path", "error", "p.*")


def project_spans(parsed: DataFrame) -> DataFrame:
    """One row per span of a project's tracks, with the track's columns, defaults filled in, and its keyframes nested."""
    t = parsed.select(F.col("path").alias("media_id"), F.explode("video_tracks").alias("t"))
    s = t.select("media_id", "t", F.posexplode("t.spans").alias("span_no", "s"))
    nested = F.transform(F.map_entries("s.keyframes"), lambda e: F.struct(e["key"].cast("bigint").alias("frame"), *[e["value"][k].alias(c) for k, c in enumerate("xywh")]))
    fill = {"label": "object", "shape": "rect", "pad": 0.1, "source": "manual", "enabled": True, "created_by": "", "note": ""}
    return s.select("media_id", F.col("t.id").alias("track_id"), F.col("span_no").cast("bigint").alias("span_no"), F.col("s.start_frame"), F.col("s.end_frame"), F.array_sort(F.coalesce(nested, F.array())).alias("keys"), F.nullif(F.col("t.style"), F.lit("")).alias("style"), *[F.coalesce(F.col(f"t.{c}"), F.lit(v)).alias(c) for c, v in fill.items()])


def project_words(parsed: DataFrame) -> DataFrame:
    """(media_id, segment, idx, start_s, end_s, word, confidence) of a project's transcript, numbered over its segments.

    A segment without words gives one that spans it; a word without a confidence is sure.
    """
    s = parsed.select(F.col("path").alias("media_id"), F.posexplode("transcript").alias("segment", "s"))
    own = F.transform("s.words", lambda w: F.struct(w["start"].alias("start_s"), w["end"].alias("end_s"), w["text"].alias("word"), F.coalesce(w["confidence"], F.lit(1.0)).alias("confidence")))
    one = F.array(F.struct(F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.trim("s.text").alias("word"), F.lit(1.0).alias("confidence")))
    words = s.select("media_id", "segment", F.posexplode(F.when(F.coalesce(F.size("s.words"), F.lit(0)) > 0, own).otherwise(one)).alias("pos", "w"))
    idx = (F.row_number().over(W.partitionBy("media_id").orderBy("segment", "pos")) - 1).cast("long")
    return words.select("media_id", "segment", idx.alias("idx"), "w.*")


def saved_tracks(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Files that hold a JSON list of tracks, as ``project_spans`` gives them."""
    return project_spans(whole(spark, path, glob).select("path", F.from_json("text", f"array<struct<{TRACK}>>").alias("video_tracks")))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def _frame(stem: Column) -> Column:
    """The number after the last ``_f``; null if there is none."""
    return F.regexp_extract(stem, r"^.*_f\s*(\d+)\s*$", 1).try_cast("bigint")


def _empty_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path) of files without a byte, which Spark's readers leave out; listed as the readers list theirs."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for level in ("", "*/") for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, level + glob)) or ())]
    return spark.createDataFrame([(s.getPath().toString(),) for s in found if s.isFile() and not s.getLen()], "path string")


def label_files(spark: SparkSession, path: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(labelled frames, boxes) of ``<path>/<medium>/<stem>_f<frame>.txt`` with a line ``class cx cy w h`` per box.

    An empty file is a labelled frame without boxes; shorter lines are passed over; a class beyond the list is its number.
    """
    at = F.col("path")
    named = lambda df: df.select(F.regexp_extract(at, r"([^/\\]+)[/\\][^/\\]+$", 1).alias("media_id"), _frame(_stem(at)).alias("frame"), *[c for c in df.columns if c != "path"]).where("frame is not null")
    full = named(whole(spark, path, "*.txt"))
    frames = full.select("media_id", "frame").unionByName(named(_empty_files(spark, path, "*.txt"))).distinct()
    parts = full.select("media_id", "frame", F.posexplode(F.split("text", r"\r?\n")).alias("box_no", "line")).withColumn("p", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")).where("size(p) >= 5")
    v = [F.col("p")[k].cast("double") for k in range(1, 5)]
    number = F.col("p")[0].cast("double").cast("int")
    cls = F.coalesce(F.get(F.array(*map(F.lit, classes)), number), number.cast("string")) if classes else number.cast("string")
    return frames, parts.select("media_id", "frame", "box_no", cls.alias("cls"), *clamp(Box(v[0] - v[2] / 2, v[1] - v[3] / 2, v[2], v[3])).columns())


COCO = "categories array<struct<id: bigint, name: string>>, images array<struct<id: bigint, file_name: string, width: double, height: double>>, annotations array<struct<image_id: bigint, category_id: bigint, bbox: array<double>>>"


def coco(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(labelled frames, boxes) of annotation files in pixels: boxes of unknown images go, an unknown category is its id."""
    doc = whole(spark, path, glob).select(_stem(F.col("path")).alias("media_id"), F.from_json("text", COCO).alias("d"))
    images = doc.select("media_id", F.inline("d.images")).select("media_id", F.col("id").alias("image_id"), _frame(_stem(F.col("file_name"))).alias("frame"), "width", "height").where("frame is not null")
    names = doc.select("media_id", F.inline("d.categories")).select("media_id", F.col("id").alias("category_id"), "name")
    boxes = doc.select("media_id", F.inline("d.annotations")).join(images, ["media_id", "image_id"]).join(names, ["media_id", "category_id"], "left")
    b = F.col("bbox")
    box = clamp(Box(b[0] / F.col("width"), b[1] / F.col("height"), b[2] / F.col("width"), b[3] / F.col("height")))
    return images.select("media_id", "frame").distinct(), boxes.select("media_id", "frame", F.coalesce("name", F.col("category_id").cast("string")).alias("cls"), *box.columns())


REVIEW = """array<struct<data: struct<image: string>, annotations: array<struct<was_cancelled: boolean,
 result: array<struct<type: string, value: struct<x: double, y: double, width: double, height: double, rectanglelabels: array<string>>>>>>>>"""


def reviewed(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(labelled frames, boxes) of an export of reviewed tasks: the last annotation that was not cancelled counts, tasks
    without one are not labelled; values are percentages."""
    t = whole(spark, path, glob).select(F.inline(F.from_json("text", REVIEW)))
    stem = _stem(F.col("data.image"))
    kept = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    t = t.select(F.regexp_extract(stem, r"^(.*)_f[^/]*$", 1).alias("media_id"), _frame(stem).alias("frame"), F.try_element_at(kept, F.lit(-1)).alias("last")).where("last is not null and frame is not null")
    r = t.select("media_id", "frame", F.posexplode("last.result").alias("box_no", "r")).where("r.type = 'rectanglelabels' and size(r.value.rectanglelabels) > 0")
    v = F.col("r.value")
    return t.select("media_id", "frame").distinct(), r.select("media_id", "frame", "box_no", v["rectanglelabels"][0].alias("cls"), *[(v[c] / 100).alias(n) for c, n in zip(("x", "y", "width", "height"), "xywh", strict=True)])


def tags(banners: DataFrame, by: str = "path", text: str = "text") -> DataFrame:
    """(by, section, key, value) of the indented tags that a media prober prints; a key given twice has its last value."""
    start = F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("indent"), F.array().cast("array<struct<section: string, key: string, value: string>>").alias("tags"))

    def step(s: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"[\t\r]", " "))
        indent = F.length(line) - F.length(F.ltrim(line))
        stream = F.regexp_extract(bare, r"^Stream #\d+:(\d+)", 1)
        state = lambda section, ind, found: F.struct(section.alias("section"), ind.cast("int").alias("indent"), found.alias("tags"))
        none = F.lit(None).cast("int")
        name, value = F.trim(F.substring_index(bare, ":", 1)), F.trim(F.regexp_replace(bare, r"^[^:]*:", ""))
        tag = F.array(F.struct(s["section"].alias("section"), name.alias("key"), value.alias("value")))
        is_tag = bare.contains(":") & (name != "") & s["section"].isNotNull()
        return (
            F.when(bare.startswith("Input #"), state(F.lit("format"), none, s["tags"])).when(stream != "", state(F.concat(F.lit("stream"), stream), none, s["tags"]))
            .when(bare == "Metadata:", state(s["section"], indent, s["tags"])).when(s["indent"].isNull(), s).when(indent <= s["indent"], state(s["section"], none, s["tags"]))
            .when(is_tag, state(s["section"], s["indent"], F.concat(s["tags"], tag))).otherwise(s)
        )

    found = banners.select(by, F.posexplode(F.aggregate(F.split(text, "\n"), start, step, lambda s: s["tags"])).alias("pos", "t"))
    return found.groupBy(by, F.col("t.section").alias("section"), F.col("t.key").alias("key")).agg(F.max_by("t.value", "pos").alias("value"))


def settings(files: DataFrame, defaults: dict[str, object], text: str = "text") -> DataFrame:
    """``files`` with ``settings``: a map of JSON values, the defaults overlaid by the file and brought to revision 4.

    A null or broken text gives the defaults.  The four revisions: an empty language takes the default; head detection goes
    off and precise detection on; a style of pixelate becomes black (null for the last box); a margin still at the former
    default of 0.10 takes the new one.
    """
    base = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, json.dumps(v))]) if defaults else F.create_map().cast("map<string, string>")
    names = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    # A map of variants keeps every JSON type; a text that is no object has no names.
    given = F.map_from_arrays(names, F.transform(names, lambda k: F.to_json(F.try_element_at(F.try_parse_json(text).try_cast("map<string, variant>"), k))))
    m = F.map_zip_with(base, given, lambda k, a, b: F.when(F.array_contains(names, k), F.coalesce(b, F.lit("null"))).otherwise(a))
    old = files.withColumn("settings", m)
    s = F.col("settings")
    rev = F.coalesce(F.try_element_at(s, F.lit("settings_rev")).try_cast("int"), F.lit(0))
    get = lambda k: F.try_element_at(s, F.lit(k))
    default = lambda k, v: F.lit(json.dumps(defaults.get(k, v)))
    pad = F.when(get("video_pad").isNull(), 0.4).otherwise(F.coalesce(get("video_pad").try_cast("double"), F.lit(0.0)))
    changes = {
        "language": F.when((rev < 1) & F.coalesce(get("language").isin('""', "null"), F.lit(True)), default("language", "en")),
        "detect_head": F.when(rev < 2, F.lit("false")),
        "detect_precise": F.when(rev < 2, F.lit("true")),
        "default_video_style": F.when((rev < 3) & (get("default_video_style") == '"pixelate"'), F.lit('"black"')),
        "last_box_style": F.when((rev < 3) & (get("last_box_style") == '"pixelate"'), F.lit("null")),
        "video_pad": F.when((rev < 4) & (F.abs(pad - 0.1) < 1e-6), default("video_pad", 0.4)),
        "settings_rev": F.greatest(rev, F.lit(4)).cast("string"),
    }
    new = F.map_filter(F.create_map(*[c for k, v in changes.items() for c in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return old.withColumn("settings", F.map_zip_with(s, new, lambda k, a, b: F.coalesce(b, a)))


def snapshot(settings_map: Column, names: list[str]) -> Column:
    """The named settings; those that are absent are left out."""
    return F.map_filter(settings_map, lambda k, v: k.isin(*names))
