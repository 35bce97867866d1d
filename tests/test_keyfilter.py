"""The key filter never loses a key and passes few others."""

import re

import pytest
from pyspark.sql import functions as F

from citeframe.functions.timeline import year_start_ns
from citeframe.operators.keyfilter import key_blocks, may_hold
from citeframe.operators.sequences import build_examples
from citeframe.plans import views
from citeframe.plans.export import sharded_examples

from test_plans import plan_of


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_every_key_passes_and_few_others(spark, kind):
    rows = spark.range(0, 60_000, 1, 4).select(F.col("id").cast(kind).alias("k"), F.col("id").alias("words")).union(
        spark.createDataFrame([(None, 1)], f"k {kind}, words bigint")
    )
    keys = rows.where("words % 20 = 3").union(rows.where("k is null"))
    blocks = key_blocks(keys, "k", 2)
    assert blocks.count() == 2
    passed = may_hold(rows, "k", blocks, 2)
    assert passed.columns == rows.columns
    assert passed.join(keys.where("k is not null"), "k").count() == 3000
    assert passed.where("k is null").isEmpty()
    assert passed.count() < 3000 + 57_000 * 0.01


def test_no_keys_pass_nothing(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert may_hold(rows, "k", key_blocks(rows.where("k < 0"), "k")).isEmpty()


def _bits_before_the_exchange(plan):
    """The vector scan is joined to the broadcast blocks below its first shuffle."""
    scans = [i for i, line in enumerate(plan.splitlines()) if "Scan parquet" in line and "embedding" in line]
    lines = plan.splitlines()
    assert len(scans) == 1
    above = lines[: scans[0]]
    shuffle = max(i for i, line in enumerate(above) if "Exchange hashpartitioning" in line)
    return any("BroadcastHashJoin [_block" in line for line in above[shuffle:])


def test_one_year_of_an_export_filters_the_vector_scan(spark, sf, tmp_path):
    path = str(tmp_path / "vectors")
    views.vectors(spark, sf).write.parquet(path)
    papers, vectors = views.labelled_papers(spark, sf), spark.read.parquet(path)
    one = sharded_examples(papers, vectors, 1997, 1998, 1, 50, 3, 64)
    whole = sharded_examples(papers, vectors, 1997, 1998, 1, 50, 3, 64, filter_vectors=False)
    assert _bits_before_the_exchange(plan_of(one)) and not re.search(r"BroadcastHashJoin \[_block", plan_of(whole))
    assert sorted(one.collect()) == sorted(whole.collect())


def test_a_wide_range_filters_the_vector_scan(spark, sf, tmp_path):
    path = str(tmp_path / "vectors")
    views.vectors(spark, sf).write.parquet(path)
    papers, vectors = views.papers(spark, sf), spark.read.parquet(path)
    low, high = year_start_ns(1996), year_start_ns(1997)
    rows = build_examples(papers, vectors, 4, 64, low=low, high=high, broadcast_keys=100)
    plain = build_examples(papers, vectors, 4, 64, low=low, high=high, filter_vectors=False)
    assert _bits_before_the_exchange(plan_of(rows))
    assert sorted(rows.collect()) == sorted(plain.collect())
