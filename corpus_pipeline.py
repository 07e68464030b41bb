"""From raw documents to a training mix: each stage is one text operator, run over all rows its predecessor kept.

Every stage's result is written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordaudit.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from recordaudit.session import ship, written

#: Similarity in percent from which documents are near-duplicates in the mix; op1's own threshold is its contract's.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one that has no word left is dropped.

    ``n_chars``, where there is one, follows the new text.
    """
    cut = line_dedup.drop_repeats(docs)
    left = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0
    columns = [F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
               if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cut.filter((F.col("lines_removed") == 0) | F.coalesce(left, F.lit(False))).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs, NEAR)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes words from, with the words taken (repeats counted)."""
    return mixing.mix(docs).filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mix", source_mix),
]

#: Word edit distances can't be expressed in SQL; tests/llm compares the pipeline with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
