"""Detections, keyframes, spans, words and time stamps derived from the driver's tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import norm_token, norm_tokens

#: Ten boxes or so per medium and frame; coordinates are multiples of 1/128, so that arithmetic is exact.
DETS = """SELECT event_id AS det_no, CAST(user_id % 8 AS BIGINT) AS media_id, CAST(floor(event_id / 80) AS BIGINT) AS frame,
 CASE event_id % 5 WHEN 0 THEN 'face' WHEN 1 THEN 'person' WHEN 2 THEN 'car' WHEN 3 THEN 'license_plate' ELSE 'phone' END AS label,
 ((event_id * 37) % 128) / 128 AS score, ((user_id * 17 + event_id * 3) % 96) / 128 AS x, ((user_id * 29 + event_id * 5) % 96) / 128 AS y,
 (8 + (event_id * 7) % 24) / 128 AS w, (8 + (event_id * 11) % 24) / 128 AS h, event_type AS source FROM events"""

#: One keyframe per track and frame: the last of the frame's events.
KEYS = """SELECT CAST(user_id % 8 AS BIGINT) AS media_id, user_id AS track_id, CAST(floor(event_id / 2) AS BIGINT) AS frame,
 max(((user_id * 17 + event_id * 3) % 96) / 128) AS x, max(((user_id * 29 + event_id * 5) % 96) / 128) AS y,
 max((8 + (event_id * 7) % 24) / 128) AS w, max((8 + (event_id * 11) % 24) / 128) AS h, max(((event_id * 37) % 128) / 128) AS score,
 CASE user_id % 5 WHEN 0 THEN 'face' WHEN 1 THEN 'head' WHEN 2 THEN 'car' WHEN 3 THEN 'license_plate' ELSE 'phone' END AS label
 FROM events GROUP BY user_id, floor(event_id / 2)"""

#: Runs of keyframes at most GAP frames apart.
GAP = 60
SPANS = f"""SELECT media_id, track_id, label, run AS span_no, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_keys FROM
 (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) <= {GAP} THEN 0 ELSE 1 END AS new FROM ({KEYS}) k) g) r
 GROUP BY media_id, track_id, label, run"""

#: Duck side of ``words``: a word every half second; a conversation is a medium.
WORDS = r"""SELECT media_id, idx, word, norm, idx * 0.5::DOUBLE AS start_s, idx * 0.5::DOUBLE + 0.4::DOUBLE AS end_s, ((idx * 31) % 100) / 100 AS confidence FROM
 (SELECT conv_id AS media_id, turn, pos, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS idx,
  trim(regexp_replace(lower(strip_accents(word)), '[^\pL\pN\pM_'']+', '', 'g'), '''') AS norm FROM
  (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\s+')) AS word, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS pos FROM conversations))"""

#: The same over documents: a document is a medium with one turn.
DOC_WORDS = WORDS.replace("FROM conversations", "FROM (SELECT doc_id AS conv_id, 0 AS turn, text FROM documents)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(KEYS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPANS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, idx, word, norm, start_s, end_s, confidence) of conversations."""
    return _words(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), "turn", "text"))


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of documents, which hold what conversations lack: numbers, addresses, e-mail."""
    return _words(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.lit(0).alias("turn"), "text"))


def doc_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_words`` as lists, a row per medium: (media_id, first, words, norms); only texts are shuffled, not words."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("media_id"), "text")
    media = docs.groupBy("media_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    cut = lambda t: F.split(t, r"\s+")
    # Texts that share a doc_id are one medium, whose words come by their place in their text, as in ``doc_words``.
    placed = F.flatten(F.transform("texts", lambda t, k: F.transform(cut(t), lambda w, p: F.struct(p.alias("p"), k.alias("k"), w.alias("w")))))
    whole = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "))
    text = media.select("media_id", whole.alias("text"))
    return text.select("media_id", F.lit(0).cast("long").alias("first"), cut(F.col("text")).alias("words"), norm_tokens(F.col("text")).alias("norms"))


def _words(turns: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    split = turns.select("media_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    idx = (F.row_number().over(W.partitionBy("media_id").orderBy("turn", "pos")) - 1).cast("long")
    numbered = split.select("media_id", idx.alias("idx"), "word")
    return numbered.select("media_id", "idx", "word", norm_token(F.col("word")).alias("norm"), (F.col("idx") * 0.5).alias("start_s"), (F.col("idx") * 0.5 + 0.4).alias("end_s"), ((F.col("idx") * 31) % 100 / 100).alias("confidence"))
