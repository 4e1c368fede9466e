"""Queries of what files and tools say: project documents, model files, probe banners, batch results, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files, inventory
from tessera.sources.adapters import table

from .registry import query


@query(r"""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS segment, regexp_split_to_array(text, ' ') AS parts, text FROM conversations),
 w AS (SELECT conv_id, segment, turn, unnest(parts) AS word, unnest(range(len(parts))) AS pos FROM t WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, segment, turn, trim(text), 0 FROM t WHERE turn % 3 = 0)
 SELECT 'clip' || conv_id AS media_id, CAST(segment AS INTEGER) AS segment, row_number() OVER (PARTITION BY conv_id ORDER BY segment, pos) - 1 AS idx, turn * 10 + CASE WHEN turn % 3 = 0 THEN 0 ELSE pos * 0.5::DOUBLE END AS start_s, turn * 10 + CASE WHEN turn % 3 = 0 THEN 9 ELSE pos * 0.5::DOUBLE + 0.25::DOUBLE END AS end_s, word, 1.0::DOUBLE AS confidence FROM w""")
def project_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the transcripts of project documents; each third turn has a text but no words."""
    t = table(spark, sf_dir, "conversations")
    word = lambda v, k: F.struct((F.col("turn") * 10 + k * 0.5).alias("start"), (F.col("turn") * 10 + k * 0.5 + 0.25).alias("end"), v.alias("text"))
    words = F.when(F.col("turn") % 3 != 0, F.transform(F.split("text", " "), word))
    segment = F.struct((F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 9).cast("double").alias("end"), "text", words.alias("words"))
    each = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", segment.alias("s")))), lambda x: x["s"]).alias("transcript"))
    documents = each.select(F.concat(F.lit("clip"), "conv_id").alias("path"), F.to_json(F.struct(F.lit("some-project").alias("format"), "transcript")).alias("text"))
    return files.project_words(files.parsed_projects(documents, "some-project").where("error is null"))


REGISTRY = "SELECT s_name AS name, 'm' || CAST(s_suppkey AS VARCHAR(9)) AS filename, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE {hash}('v' || CAST(s_suppkey % 5 AS VARCHAR(9)){bits}) END AS sha256, s_suppkey % 4 = 0 AS optional, s_suppkey % 50 AS min_bytes FROM {t}"
FILES = "SELECT c_nationkey AS place, 'dir' || CAST(c_nationkey AS VARCHAR(9)) AS directory, 'm' || CAST(c_custkey % 90 AS VARCHAR(9)) AS filename, min(c_custkey % 60) AS bytes, {hash}('v' || CAST(min(c_custkey) % 5 AS VARCHAR(9)){bits}) AS sha256 FROM {t} GROUP BY c_nationkey, c_custkey % 90"
INSTALLED = f"r AS ({REGISTRY.format(hash='sha256', bits='', t='supplier')}), f AS ({FILES.format(hash='sha256', bits='', t='customer')}), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY place) AS rn FROM f) x WHERE rn = 1)"


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda sql, name: spark.sql(sql.format(hash="sha2", bits=", 256", t="{t}"), t=table(spark, sf_dir, name))
    return read(REGISTRY, "supplier"), read(FILES, "customer")


@query(f"WITH {INSTALLED} SELECT name, directory, r.filename, bytes, one.sha256 AS sha256, nullif(r.sha256, '') AS registry_sha256, one.sha256 = nullif(r.sha256, '') AS matches_registry FROM r JOIN one ON one.filename = r.filename")
def model_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model files that are there, by the first folder that has them."""
    return inventory.installed(*_models(spark, sf_dir))


@query(f"WITH {INSTALLED} SELECT * FROM (SELECT name, CASE WHEN bytes IS NULL THEN CASE WHEN NOT optional THEN 'missing' END WHEN bytes < min_bytes THEN 'short' WHEN one.sha256 <> nullif(r.sha256, '') THEN 'differs' END AS fault FROM r LEFT JOIN one ON one.filename = r.filename) x WHERE fault IS NOT NULL")
def model_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model files that are missing, cut short or other than published."""
    return inventory.model_faults(*_models(spark, sf_dir))


# Banners as a probe prints them; every fifth clip has a cover only, every seventh no sound.
BANNER = """concat('Input #0, mov, from ''clip''', chr(10), '  Duration: 0', CAST(event_id % 3 AS VARCHAR(9)), ':', CAST(10 + user_id % 50 AS VARCHAR(9)), ':0', CAST(event_id % 10 AS VARCHAR(9)), '.50, start: 0.000', chr(10),
 CASE WHEN event_id % 5 = 0 THEN '  Stream #0:2: Video: mjpeg, yuvj420p, 300x300, 90k tbr (attached pic)' ELSE concat('  Stream #0:0(und): Video: h264 (High) (avc1 / 0x31637661), yuv420p(tv, bt709), ', CAST(640 + user_id % 7 * 64 AS VARCHAR(9)), 'x', CAST(480 + user_id % 5 * 60 AS VARCHAR(9)), ' [SAR 1:1], 4000 kb/s, ', CASE WHEN user_id % 2 = 0 THEN '29.97' ELSE '25' END, ' fps, 25 tbr') END, chr(10),
 CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('  Stream #0:1(eng): Audio: aac (LC), ', CASE WHEN event_id % 2 = 0 THEN '44100' ELSE '48000' END, ' Hz, ', CASE event_id % 4 WHEN 0 THEN 'mono' WHEN 1 THEN 'stereo' WHEN 2 THEN '6 channels' ELSE '5.1' END, ', fltp, 128 kb/s') END)"""


@query("""SELECT event_id, event_id % 3 * 3600 + (10 + user_id % 50) * 60 + event_id % 10 + 0.5::DOUBLE AS duration, CASE WHEN event_id % 5 <> 0 THEN 'h264' END AS video_codec, CAST(CASE WHEN event_id % 5 <> 0 THEN 640 + user_id % 7 * 64 END AS INTEGER) AS width, CAST(CASE WHEN event_id % 5 <> 0 THEN 480 + user_id % 5 * 60 END AS INTEGER) AS height,
 CASE WHEN event_id % 5 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN 29.97::DOUBLE ELSE 25 END END AS fps, CASE WHEN event_id % 7 <> 0 THEN 'aac' END AS audio_codec, CAST(CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 44100 ELSE 48000 END END AS INTEGER) AS sample_rate,
 CAST(CASE WHEN event_id % 7 <> 0 THEN CASE event_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 6 ELSE 2 END END AS INTEGER) AS channels FROM events""")
def probe_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration and streams that probes printed."""
    return table(spark, sf_dir, "events").select("event_id", inventory.probed(F.expr(BANNER)).alias("p")).select("event_id", "p.*")


@query("""WITH r AS (SELECT CASE event_id % 6 WHEN 0 THEN 'ValueError: no stream' WHEN 1 THEN 'OSError: file ' || CAST(user_id % 3 AS VARCHAR) END AS line, CASE WHEN event_id % 6 > 1 THEN user_id % 4 END AS uncovered FROM events)
 SELECT count(*) AS files, count(*) FILTER (line IS NULL) AS ok, CAST(sum(uncovered) AS BIGINT) AS uncovered, (SELECT line FROM r WHERE line IS NOT NULL GROUP BY line ORDER BY count(*) DESC, line DESC LIMIT 1) AS commonest_error FROM r""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a batch went, with errors as data."""
    kind = F.col("event_id") % 6
    error = F.when(kind == 0, F.lit("ValueError: no stream\n  at open")).when(kind == 1, F.concat(F.lit("OSError: file "), F.col("user_id") % 3, F.lit("\n  at read")))
    return inventory.batch_summary(table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), error.alias("error"), F.when(kind > 1, F.col("user_id") % 4).alias("uncovered")))
