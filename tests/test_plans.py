"""Physical plans: limits before shuffles, one vector shuffle, no Python, and skew handling."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citeframe.functions.timeline import year_start_ns
from citeframe.operators import citations, skew
from citeframe.operators.sequences import build_examples
from citeframe.operators.slicing import time_slices
from citeframe.plans import views
from citeframe.sources import scratch, shards


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def conf(spark):
    """Sets session values for one test."""
    saved = {}

    def put(**values):
        for k, v in values.items():
            key = "spark.sql." + k.replace("__", ".")
            saved[key] = spark.conf.get(key, None)
            spark.conf.set(key, v)

    yield put
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rank_limit_runs_on_both_sides_of_the_shuffle(spark, sf):
    plan = plan_of(entry.rank_references(spark, sf))
    limits = re.findall(r"WindowGroupLimit.*?(Partial|Final)", plan)
    assert limits == ["Final", "Partial"]


def test_time_ranges_reach_the_scan(spark, sf):
    path = scratch.new_path(spark, "papers")
    views.papers(spark, sf).write.parquet(path)
    papers = spark.read.parquet(path)
    vectors = views.vectors(spark, sf)
    for df in (time_slices(papers, 1996, 1998), build_examples(papers, vectors, 4, 64, low=5, high=9)):
        # The printed list is cut off after the first bound.
        assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(publication_date_int,\d+\), Le", plan_of(df))
    # The lookup of dates reads two columns of the papers.
    assert "ReadSchema: struct<id:bigint,publication_date_int:bigint>" in plan_of(build_examples(papers, vectors, 4, 64))


def test_a_small_range_filters_the_vector_scan(spark, sf):
    """The ids are broadcast only while their number is under the limit; the examples are the same."""
    papers, vectors = views.papers(spark, sf), views.vectors(spark, sf)
    low, high = year_start_ns(1996), year_start_ns(1997)
    few = build_examples(papers, vectors, 4, 64, low=low, high=high)
    many = build_examples(papers, vectors, 4, 64, low=low, high=high, broadcast_keys=100)
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plan_of(few))
    assert "LeftSemi" not in plan_of(many) and "LeftSemi" not in plan_of(build_examples(papers, vectors, 4, 64))
    assert sorted(few.collect()) == sorted(many.collect())


def test_vectors_are_shuffled_once_with_the_steps_and_once_assembled(spark, sf, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    papers = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("publication_date_int"), F.array("o_custkey").alias("refs")
    )
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    focal = papers.withColumn("shard", F.col("id") % 7)
    plan = plan_of(build_examples(papers, vectors, 4, 64, focal=focal, group_keys=["shard"]))
    # Edges and dates by reference, ranks by paper, steps and vectors by reference, assembly by shard.
    assert plan.count("Exchange hashpartitioning") == 6
    assert plan.count("embedding#") and len(re.findall(r"Scan parquet.*?embedding", plan)) == 1
    assert "REPARTITION_BY_COL" in plan


def test_exported_steps_are_sorted_once(spark, sf, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    papers, vectors = views.papers(spark, sf), spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    focal = papers.select("*", *[(F.col("id") % 7).alias(k) for k in shards.SHARD_KEYS])
    examples = build_examples(papers, vectors, 4, 64, focal=focal, group_keys=shards.SHARD_KEYS, hot={})
    plan = plan_of(examples.sortWithinPartitions(*shards.SHARD_KEYS)).splitlines()
    shuffled = [i for i, line in enumerate(plan) if "Exchange" in line]
    # Between the shuffle by shard and the file: one sort, which the write shares, and no grouping.
    above = "\n".join(plan[: shuffled[0]])
    assert len(re.findall(r"\bSort \[", above)) == 1 and "Aggregate" not in above
    # The steps leave the lookup of their dates as they come out of it.
    dates = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line and "Inner" in line)
    by_paper = max(i for i in shuffled if i < dates)
    assert not any("Sort [" in line for line in plan[by_paper:dates])


def test_a_paper_meets_its_own_vector_where_it_lies(spark, sf, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    papers, vectors = views.papers(spark, sf), spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    plan = plan_of(build_examples(papers, vectors, 4, 64, hot={})).splitlines()
    sides = next(i for i, line in enumerate(plan) if "FullOuter" in line)
    own, cited = [i for i, line in enumerate(plan) if "SortMergeJoin" in line and "LeftOuter" in line]
    assert sides < own < cited
    # Above the join with the own vectors nothing is shuffled; above that with the cited ones it is once, ungrouped.
    assert not any("Exchange" in line for line in plan[:own])
    assert sum("Exchange" in line and "REPARTITION_BY_COL" in line for line in plan[own:cited]) == 1
    # Both parts read one shuffle of the vectors.
    assert sum("Scan parquet" in line and "embedding#" in line for line in plan) == 1


@pytest.mark.parametrize("name", sorted({q.__name__ for q in entry._QUERIES} - {"lr_trials", "lr_search_best", "lr_fold_metrics", "lr_test_scores"}))
def test_no_query_runs_python_or_a_cross_join(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    for word in ("Python", "InPandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, f"{name} uses {word}"


@pytest.fixture(scope="module")
def popular(spark):
    """25,000 papers; half of all edges cite paper 0."""
    ids = spark.range(0, 25_000, 1, 16).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(25_000)))
    papers = ids.select("id", (F.col("id") * 7).alias("publication_date_int"), F.array(F.lit(0).cast("bigint"), "x").alias("refs"))
    vectors = ids.select("id", F.array(F.col("id").cast("float"), F.col("x").cast("float")).alias("embedding"))
    return papers, vectors


def test_hot_references_are_split_in_both_lookups(popular, conf):
    conf(
        shuffle__partitions="32", autoBroadcastJoinThreshold="-1", adaptive__coalescePartitions__enabled="false",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20000", adaptive__advisoryPartitionSizeInBytes="20000",
    )
    rows = build_examples(*popular, 2, 2)
    assert len(rows.collect()) == 25_000
    assert len(re.findall(r"SortMergeJoin\(skew=true\)", plan_of(rows))) == 2


def test_without_adaptive_execution_hot_keys_are_dealt_out(popular, spark, conf):
    want = sorted(build_examples(*popular, 2, 2).collect())
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    papers, vectors = popular
    edges = citations.explode_references(papers)
    hot = skew.hot_keys(edges, "ref_id", 0.05)
    assert list(hot) == [0] and hot[0] in (10, 11)
    rows = build_examples(papers, vectors, 2, 2)
    assert len(re.findall(r"SortMergeJoin \[ref_id#\d+L, _copy#\d+\]", plan_of(rows))) == 2
    assert sorted(rows.collect()) == want
    dated = citations.reference_dates(edges, papers, hot=hot)
    assert dated.rdd.mapPartitions(lambda it: [sum(r["ref_id"] == 0 for r in it)]).max() < 12_000
    for f in (citations.available_references, citations.reference_dates):
        assert sorted(f(edges, papers, hot=hot).collect()) == sorted(f(edges, papers, hot={}).collect())


def test_no_hot_key_in_even_or_empty_data(spark):
    assert skew.hot_keys(spark.range(1000), "id", 0.01) == {}
    assert skew.hot_keys(spark.range(0), "id", 0.01) == {}


def test_exported_slices_follow_the_papers(spark, sf):
    assert views.papers(spark, sf).count() == entry.exported_manifest(spark, sf).agg(F.sum("n_examples")).first()[0]
