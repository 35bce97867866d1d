"""A cleaning pipeline over ``documents``: each stage is one operator, its result written and read again by the next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm import decontamination, quality, simhash, suffixes, tokens
from citeframe.sources import scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group."""
    return simhash.keep_one(spark, docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated byte strings out of texts; a character that is cut in two goes with them."""

    @F.pandas_udf("string")
    def text(kept: pd.Series) -> pd.Series:
        return pd.Series([b.decode("utf-8", "ignore") for b in kept], dtype=object)

    rest = suffixes.remove_repeats(spark, docs).withColumn("text", text(F.col("kept")))
    return rest.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage. Texts are told apart by digest, so that missing or repeated ids take no
    clean document with them."""
    key = F.md5(F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("doc_id"), "text")
    found = decontamination.contamination(spark, keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("bad_key"))
    return docs.join(bad, key == F.col("bad_key"), "left_anti")


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode(spark, docs)


STAGES = [
    ("quality_classifier", quality_filter), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_filter), ("sentencepiece", tokenised),
]

#: A fitted classifier and hashed stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
