"""Extensions over the driver's tables: cubes, session and tumbling windows, confusion counts, a reporting query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.sources.adapters import table

from .registry import query


@query("SELECT coalesce(event_type, 'all') AS event_type, coalesce(CAST(user_id % 4 AS BIGINT), -1) AS part, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY CUBE (event_type, user_id % 4)")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("part"), "value")
    return e.cube("event_type", "part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("part", F.lit(-1)).alias("part"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT user_id, min(ts) AS started, count(*) AS n FROM r GROUP BY user_id, run""")
def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(F.col("w.start").alias("hour"), "event_type", "n", "peak")


@query("SELECT d.lang, l.quality, l.toxic, count(*) AS n, sum(d.n_chars) AS chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang, l.quality, l.toxic")
def ext_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def ext_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return item.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) t WHERE rn <= 10")
def ext_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("rn", rank).where("rn <= 10").select("event_type", "event_id", "value")
