"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return
the columns of documents; the last returns packed pieces.
  quality_rules              documents that the base rules or the adaptive limits reject go
  line_dedup                 repeated passages go, but for their first occurrence; texts and n_chars are updated;
                             a document of which nothing is left goes
  jaccard_join               of each group of similar documents one row stays: that with the smallest id (a null id
                             last), then the smallest text hash, then the smallest other columns as JSON; so rows
                             with one id and text are copies even where their other columns differ. A document
                             without words is in no group and stays
  benchmark_decontamination  documents that contain a benchmark window go
  packing                    what is left becomes sequences of at most 2048 tokens
Nulls are carried in any column; an empty table gives no rows; further columns are kept, whatever their names, but
for names that begin with __q_, __l_, __j_ or __b_, which belong to the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import decontam, jaccard, linedup, packing, quality
from tarnlight.llm.scratch import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where(quality.q("kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linedup.dedup_lines(docs)
    done = done.where((F.col("__l_removed_chunks") == 0) | F.col("text").rlike(linedup.FILLED)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    groups = jaccard.similar_documents(docs, text_hash=True)
    first = groups.select(F.col("__j_first.id").alias("__j_i"), F.col("__j_first.th").alias("__j_t")).distinct()
    known = docs.select(*cols, F.xxhash64("text").alias("__j_th"))
    stay = known.join(first, F.col("doc_id").eqNullSafe(F.col("__j_i")) & F.col("__j_th").eqNullSafe(F.col("__j_t")), "left_semi")
    row = F.struct(*cols).alias("row")
    one = stay.groupBy("doc_id", "__j_th").agg(F.min_by(row, F.to_json(F.struct(*others))).alias("row")) if others else stay.groupBy("doc_id", "__j_th").agg(F.first(row).alias("row"))
    return one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.decontaminate(docs, benchmark, carry=docs.columns)
    return found.where("size(__b_hits) = 0").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL has no byte-level BPE encoder; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
