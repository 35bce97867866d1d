"""Versions of an export: appended papers give what a full export gives, and readers never see half a version."""

import re
import time

import pytest
from pyspark.sql import functions as F

from citeframe.functions.timeline import year_start_ns
from citeframe.plans import append
from citeframe.plans.export import sharded_examples
from citeframe.sources import published, scratch, shards

SHAPE = append.Shape(2000, 2004, 3, 2, 2, ("y",))


@pytest.fixture(scope="module")
def tables(spark):
    """Papers 0..39 over four years; paper 31 of 2000 and paper 12 of 2001 cite paper 35, which comes last."""
    rows = []
    for i in range(40):
        refs = [i - 1, i - 2, 900 + i] + ([35] if i in (31, 12) else [])
        rows.append((i, year_start_ns(2000 + (i * 7) % 4) + i * 10**9, refs if i % 9 else None, i % 2))
    papers = spark.createDataFrame(rows, "id bigint, publication_date_int bigint, refs array<bigint>, y int")
    vectors = papers.select("id", F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    return papers, vectors


def rows_of(df):
    return sorted(map(tuple, df.select("id", "shard", "slice_start", "slice_end", "publication_date_int", "features", "target").collect()))


def read(spark, root, **options):
    return published.read_published(spark, root, SHAPE.timepoints, SHAPE.n_features, **options)


@pytest.fixture(scope="module")
def full(spark, tables):
    root = scratch.new_path(spark, "published")
    assert append.first_export(*tables, root, SHAPE) == 1
    return rows_of(read(spark, root))


def test_an_append_equals_a_full_export_and_rewrites_only_changed_slices(spark, tables, full):
    papers, vectors = tables
    root, is_new = scratch.new_path(spark, "published"), F.col("id") == 35
    append.first_export(papers.where(~is_new), vectors, root, SHAPE)
    before = rows_of(read(spark, root))
    new_ids = papers.where(is_new).select("id")
    stale = sorted(r[0] for r in append.stale_examples(spark, root, new_ids).collect())
    # Papers 36 and 37 cite the two papers before them.
    assert stale == [12, 31, 37]
    assert append.append_papers(papers, new_ids, vectors, root, SHAPE) == 2
    assert rows_of(read(spark, root)) == full
    assert rows_of(read(spark, root, version=1)) == before
    folders = {r["slice_start"]: r["folder"] for r in published.version_slices(spark, root).collect()}
    old = {r["slice_start"]: r["folder"] for r in published.version_slices(spark, root, 1).collect()}
    changed = {r["slice_start"] for r in read(spark, root).where(F.col("id").isin([*stale, 35])).select("slice_start").collect()}
    assert {s for s in old if folders[s] != old[s]} == changed and len(changed) < len(old)


def test_slices_that_were_empty_and_ids_that_change_nothing(spark, tables, full):
    papers, vectors = tables
    root, late = scratch.new_path(spark, "published"), F.col("publication_date_int") >= year_start_ns(2002)
    append.first_export(papers.where(~late), vectors, root, SHAPE)
    assert append.append_papers(papers, papers.where("false").select("id"), vectors, root, SHAPE) == 1
    assert append.append_papers(papers, papers.where(late).select("id"), vectors, root, SHAPE) == 2
    assert rows_of(read(spark, root)) == full
    assert published.published_manifest(spark, root).agg(F.sum("n_examples")).first()[0] == len(full)


def test_a_writer_that_stops_leaves_the_old_version(spark, tables, monkeypatch):
    papers, vectors = tables
    root, is_new = scratch.new_path(spark, "published"), F.col("id") >= 30
    append.first_export(papers.where(~is_new), vectors, root, SHAPE)
    before, manifest = rows_of(read(spark, root)), sorted(published.published_manifest(spark, root).collect())

    def stop(*_, **__):
        raise RuntimeError("stopped")

    # Between the shards and their counts, and between the counts and the version.
    for step in ("write_manifest", "commit"):
        with monkeypatch.context() as patch:
            patch.setattr(published, step, stop)
            with pytest.raises(RuntimeError, match="stopped"):
                append.append_papers(papers, papers.where(is_new).select("id"), vectors, root, SHAPE)
        assert published.last_version(spark, root) == 1
        assert rows_of(read(spark, root)) == before
        assert sorted(published.published_manifest(spark, root).collect()) == manifest


def test_ranges_and_missing_versions(spark, tables, full):
    root = scratch.new_path(spark, "published")
    assert published.last_version(spark, root) == 0
    with pytest.raises(ValueError, match="no examples"):
        read(spark, root)
    with pytest.raises(ValueError, match="nothing is published"):
        published.published_manifest(spark, root)
    append.first_export(*tables, root, SHAPE)
    low, high = year_start_ns(2001), year_start_ns(2002)
    want = [r for r in full if low <= r[4] < high]
    assert rows_of(read(spark, root, t_min=low, t_max=high)) == want
    assert len({r[2] for r in rows_of(read(spark, root, t_min=low, t_max=high, boundary="overlap"))}) >= 1


def test_copied_examples_are_shuffled_once(spark, tables, monkeypatch):
    papers, vectors = tables
    root, is_new, plans = scratch.new_path(spark, "published"), F.col("id") == 35, []
    append.first_export(papers.where(~is_new), vectors, root, SHAPE)

    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")

    def look(examples, *_, **__):
        plans.append(examples.sortWithinPartitions(*shards.SHARD_KEYS)._jdf.queryExecution().explainString(formatted))

    monkeypatch.setattr(published, "write_shards", look)
    monkeypatch.setattr(published, "write_manifest", lambda *_, **__: None)
    monkeypatch.setattr(published, "commit", lambda *_: 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        append.append_papers(papers, papers.where(is_new).select("id"), vectors, root, SHAPE)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def wide(plan, node):
        found = re.findall(rf"\n\(\d+\) {node}[^\n]*\nInput \[\d+\]: \[(.*)\]", plan)
        return sum("features#" in columns for columns in found)

    # One for the copies, and one sort of them; the built ones are put together behind the shuffle of their steps.
    assert sum(wide(p, "Exchange") for p in plans) == sum(wide(p, "Sort") for p in plans) == 1


def test_renumbered_rows_are_those_of_the_join(spark):
    columns = "id bigint, slice_start bigint, slice_end bigint, shard int, features array<float>"
    # Paper 3 was stored twice and 5 in two shards, 7 has two new shards, 9 lies in two slices, 4 and 8 are not wanted.
    stored = [(1, 0, 9, 0), (2, 0, 9, 0), (3, 0, 9, 0), (3, 0, 9, 0), (4, 0, 9, 1), (5, 0, 9, 1), (5, 0, 9, 2), (7, 0, 9, 2), (8, 0, 9, 2)]
    stored += [(9, 0, 9, 3), (9, 9, 18, 0), (10, 9, 18, 0), (None, 9, 18, 0)]
    stored = spark.createDataFrame([(*r, [float(i)]) for i, r in enumerate(stored)], columns)
    moved = [(1, 0), (2, 1), (3, 1), (3, 1), (5, 2), (7, 2), (7, 3), (9, 4), (9, 0), (10, 0), (None, 0), (11, 0)]
    numbers = spark.createDataFrame(moved, "id bigint, shard int")
    want = stored.drop("shard").join(numbers, "id")
    got = append._renumbered(stored, numbers)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_written_shards_leave_no_shuffle_files(spark, tables):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.mkString(" ")))

    papers, vectors = tables
    examples = sharded_examples(papers, vectors, 2000, 2004, 1, 3, 2, 2, ["y"], filter_vectors=False)
    before = files()
    shards.write_shards(examples, scratch.new_path(spark, "examples"), 3, overwrite=True)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(scratch.DROP_SHUFFLES) != "true"
