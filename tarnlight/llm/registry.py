"""Queries of this subpackage, over the whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, decontam, htmldiff, jaccard, linedup, packing, quality, secrets, shards, urlrules
from .scratch import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute_tokens(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_mirrored(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.digest(linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"  # what the query makes, so it stays
    blobs = shards.shard_blobs(shards.ordered(table(spark, sf_dir, "documents")))
    return shards.written_digest(shards.write_shards(blobs, uri), uri)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_decontamination, op4_secret_scan, op5_quality_rules, op6_jaccard_join, op7_url_filters, op8_line_dedup, op9_training_order, op10_html_extraction)}
ORACLE_SQL = {"op3_decontamination": decontam.ORACLE_SQL, "op5_quality_rules": quality.ORACLE_SQL, "op6_jaccard_join": jaccard.ORACLE_SQL, "op7_url_filters": urlrules.ORACLE_SQL, "op8_line_dedup": linedup.ORACLE_SQL}
