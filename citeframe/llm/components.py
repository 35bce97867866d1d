"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.sources import scratch


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch.new_path(spark, "components")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links nodes to the least node around a centre: its larger neighbours, or itself and its smaller ones."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns a, b, integers); the root is the least node of its component.

    Every round is written to the shared folder, so lineage stays short and lost executors cost one round. A centre
    with many neighbours is joined, never gathered."""
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs, before = _kept(spark, pairs.distinct()), None
    while True:
        mark = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        pairs = _kept(spark, _stars(_stars(pairs, True), False))
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
