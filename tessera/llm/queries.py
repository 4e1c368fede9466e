"""The queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, media, mixing, pseudonyms, secrets, simhash, token_output, toxicity, url_graph
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_on_disk(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_output": op1_token_output,
    "op3_simhash": op3_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op2_mixing": op2_mixing,
    "op4_html_text": op4_html_text,
    "op5_url_graph": op5_url_graph,
    "op6_secrets": op6_secrets,
    "op9_media": op9_media,
    "op10_pseudonyms": op10_pseudonyms,
}

ORACLE_SQL: dict[str, str] = {}
