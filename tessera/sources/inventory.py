"""What an installation holds and what its tools print: model files against a registry, the banner of a media probe, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a banner's lines look like.
DURATION = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
VIDEO = r"Stream #\d+:\d+.*?: Video: (\w+).*?,\s*(\d{2,5})x(\d{2,5})"
RATE = r"([\d.]+) fps"
AUDIO = r"Stream #\d+:\d+.*?: Audio: (\w+).*?,\s*(\d+) Hz,\s*([^,]+)"
CHANNELS = r"^(\d+) channels"


def installed(registry: DataFrame, files: DataFrame) -> DataFrame:
    """(name, directory, filename, bytes, sha256, registry_sha256, matches_registry) of the models that are there.

    ``registry`` (name, filename, sha256) names files, ``files`` (place, directory, filename, bytes, sha256) lists those of the folders
    in the order of ``place``: the first folder that has a file counts.  ``matches_registry`` is null where the registry has no hash.
    """
    first = files.groupBy("filename").agg(F.min_by(F.struct("directory", "bytes", F.col("sha256").alias("found")), F.struct("place", "directory")).alias("f"))
    pinned = F.nullif(F.col("sha256"), F.lit(""))
    got = registry.select("name", "filename", pinned.alias("registry_sha256")).join(first, "filename")
    return got.select("name", "f.directory", "filename", "f.bytes", F.col("f.found").alias("sha256"), "registry_sha256", (F.col("f.found") == F.col("registry_sha256")).alias("matches_registry"))


def model_faults(registry: DataFrame, files: DataFrame) -> DataFrame:
    """(name, fault) of models that can't be trusted: ``missing`` unless ``optional``, ``short`` under ``min_bytes``, ``differs`` in its hash."""
    got = registry.join(installed(registry, files).select("name", "bytes", "matches_registry"), "name", "left")
    fault = F.when(F.col("bytes").isNull(), F.when(~F.col("optional"), "missing")).when(F.col("bytes") < F.col("min_bytes"), "short").when(~F.col("matches_registry"), "differs")
    return got.select("name", fault.alias("fault")).where("fault is not null")


def probed(banner: Column) -> Column:
    """What a probe's banner says, as a struct: duration, and codec and figures of its first video and audio stream.

    Covers attached to audio are no video.  A layout without a number of channels is two unless it is mono.
    """
    lines = F.split(banner, "\r?\n")
    video = F.try_element_at(F.filter(lines, lambda v: v.rlike(VIDEO) & ~v.contains("attached pic")), F.lit(1))
    audio = F.try_element_at(F.filter(lines, lambda v: v.rlike(AUDIO) & ~v.contains("Video:")), F.lit(1))
    part = lambda line, pattern, k: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    seconds = part(banner, DURATION, 1).cast("int") * 3600 + part(banner, DURATION, 2).cast("int") * 60 + part(banner, DURATION, 3).cast("double")
    layout = F.trim(part(audio, AUDIO, 3))
    channels = F.coalesce(part(layout, CHANNELS, 1).cast("int"), F.when(layout == "mono", 1).when(layout.isNotNull(), 2))
    return F.struct(
        seconds.alias("duration"), part(video, VIDEO, 1).alias("video_codec"), part(video, VIDEO, 2).cast("int").alias("width"), part(video, VIDEO, 3).cast("int").alias("height"),
        part(video, RATE, 1).try_cast("double").alias("fps"), part(audio, AUDIO, 1).alias("audio_codec"), part(audio, AUDIO, 2).cast("int").alias("sample_rate"), channels.alias("channels"),
    )


def frame_total(counted: Column, duration: Column, fps: Column) -> Column:
    """Frames as counted, else by the duration; halves round to even."""
    return F.when(counted > 0, counted).otherwise(F.rint(duration * fps).cast("long"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Files, how many went well, uncovered boxes left and the commonest first line of an error, over (path, error, uncovered)."""
    lines = results.withColumn("line", F.element_at(F.split("error", "\n"), 1))
    worst = lines.where("line is not null").groupBy("line").agg(F.count("*").alias("n")).agg(F.max_by("line", F.struct("n", "line")).alias("commonest_error"))
    sums = lines.agg(F.count("*").alias("files"), F.count(F.when(F.col("error").isNull(), 1)).alias("ok"), F.sum("uncovered").alias("uncovered"))
    return sums.join(F.broadcast(worst))  # one row each
