"""Shards on storage: layout, replacement, manifest and pruning."""

import pytest
from pyspark.sql import functions as F

from citeframe.functions.timeline import year_start_ns
from citeframe.operators.slicing import example_count
from citeframe.plans import views
from citeframe.plans.export import export, sharded_examples, sharded_parts, year_parts
from citeframe.sources import scratch, shards
from citeframe.streaming import examples as lazy

K, N, B = 3, 64, 40


def make(spark, sf, start, end, extra=None):
    papers = views.labelled_papers(spark, sf)
    return sharded_examples(papers if extra is None else papers.where(extra), views.vectors(spark, sf), start, end, 1, B, K, N, ["above_mean"])


@pytest.fixture(scope="module")
def paths(spark, sf):
    out = scratch.new_path(spark, "examples"), scratch.new_path(spark, "manifest")
    export(make(spark, sf, 1995, 2002), *out, B, overwrite=True)
    return out


def test_every_paper_is_one_example(spark, sf, paths):
    back = shards.read_shards(spark, paths[0], K, N)
    assert back.count() == back.select("id").distinct().count() == views.papers(spark, sf).count()
    assert back.where(F.size("features") != (K + 1) * N).isEmpty()


def test_manifest_equals_the_files(spark, paths):
    manifest = shards.read_manifest(spark, paths[1])
    counted = shards.shard_counts(spark.read.parquet(paths[0]))
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, counted.select(*manifest.columns).collect()))
    assert manifest.agg(F.max("n_examples")).first()[0] == B
    row = example_count(manifest, year_start_ns(1995), year_start_ns(2002), 512).first()
    assert (row["n_examples"], row["n_batches"]) == (1500, 3)


def test_files_hold_at_most_one_shard_of_rows(spark, paths):
    rows = spark.read.parquet(paths[0]).groupBy(F.input_file_name()).count()
    assert rows.agg(F.max("count")).first()[0] <= B


def test_a_range_prunes_directories(spark, paths):
    low, high = year_start_ns(1996), year_start_ns(1997)
    df = shards.read_shards(spark, paths[0], K, N, low, high)
    assert df.select("slice_start").distinct().collect() == [(low,)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :]
    assert "slice_end" in part[:200] and "slice_start" in part[:400]
    overlap = shards.read_shards(spark, paths[0], K, N, low, high, "overlap")
    starts = {r[0] for r in overlap.select("slice_start").distinct().collect()}
    assert starts == {year_start_ns(y) for y in (1995, 1996, 1997)}


def test_an_empty_choice_is_an_error(spark, paths):
    with pytest.raises(ValueError, match="no examples"):
        shards.read_shards(spark, paths[0], K, N, 0, 1)


def test_writing_a_slice_again_replaces_it_alone(spark, sf):
    out = scratch.new_path(spark, "examples"), scratch.new_path(spark, "manifest")
    export(make(spark, sf, 1995, 1998), *out, B, overwrite=True)
    before = {tuple(r) for r in shards.read_manifest(spark, out[1]).collect()}
    files = spark.read.parquet(out[1]).select("slice_start", F.input_file_name())
    files_before = {tuple(r) for r in files.collect()}
    export(make(spark, sf, 1996, 1997, "id % 2 = 0"), *out, B, years=(1996, 1997))
    kept = {f for f in files_before if f[0] != year_start_ns(1996)}
    assert kept < {tuple(r) for r in spark.read.parquet(out[1]).select("slice_start", F.input_file_name()).collect()}
    after = {tuple(r) for r in shards.read_manifest(spark, out[1]).collect()}
    other = {r for r in before if r[0] != year_start_ns(1996)}
    assert other < after
    changed = after - other
    assert {r[0] for r in changed} == {year_start_ns(1996)}
    assert sum(r[3] for r in changed) == views.papers(spark, sf).where(
        f"id % 2 = 0 and publication_date_int >= {year_start_ns(1996)} and publication_date_int < {year_start_ns(1997)}"
    ).count()
    assert shards.read_shards(spark, out[0], K, N).count() == sum(r[3] for r in after)


def test_lazy_kept_and_iterated_examples_agree(spark, sf):
    args = views.papers(spark, sf), views.vectors(spark, sf), year_start_ns(1996), year_start_ns(1997), K, N
    rows = lazy.examples_between(*args)
    want = {r["id"]: r["features"] for r in rows.collect()}
    for on_disk in (False, True):
        kept = lazy.keep(lazy.examples_between(*args), on_disk)
        assert kept.storageLevel.useDisk and kept.storageLevel.useMemory is not on_disk
        assert {r["id"]: r["features"] for r in lazy.iterate(kept)} == want
        kept.unpersist()


def test_metric_files(spark):
    df = spark.createDataFrame([(1999, 1, 0.5, 1.0, 1.0, 1.0, 1.0), (2000, 1, 0.5, 1.0, 1.0, 1.0, 1.0)], shards.METRIC_SCHEMA)
    path = scratch.new_path(spark, "metrics")
    shards.write_metrics(df, path, 1)
    back = spark.read.option("header", True).schema(f"{shards.METRIC_SCHEMA}, span string").csv(path)
    assert sorted((r["span"], r["fold"]) for r in back.collect()) == [("1998-1999", 1999), ("1999-2000", 2000)]


def test_settings_for_wide_rows():
    got = shards.wide_row_settings(100_000_000, 50, 384)
    assert got == {"spark.sql.shuffle.partitions": "29183", "spark.sql.parquet.columnarReaderBatchSize": "856"}


def test_a_slice_that_starts_at_the_epoch_keeps_its_type(spark):
    papers = spark.createDataFrame([(1, 5, [], 1), (2, 6, [1], 0)], "id bigint, publication_date_int bigint, refs array<bigint>, y int")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id bigint, embedding array<float>")
    out = scratch.new_path(spark, "examples"), scratch.new_path(spark, "manifest")
    export(sharded_examples(papers, vectors, 1970, 1971, 1, 1, 1, 1, ["y"]), *out, 1, overwrite=True)
    rows = shards.read_shards(spark, out[0], 1, 1)
    assert dict(rows.dtypes)["slice_start"] == "bigint"
    assert {r["id"]: r["features"] for r in rows.collect()} == {1: [0.0, 1.0], 2: [1.0, 2.0]}
    assert sorted(map(tuple, shards.read_manifest(spark, out[1]).collect())) == [
        (0, year_start_ns(1971), 0, 1), (0, year_start_ns(1971), 1, 1),
    ]


def test_rows_of_a_shard_lie_together(spark, paths):
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.parquet(paths[0]).select("slice_start", "shard", place.alias("place")).collect()
    order = [(r["slice_start"], r["shard"]) for r in sorted(rows, key=lambda r: (r["place"]["file"], r["place"]["row"]))]
    starts = [b for a, b in zip([None, *order], order, strict=False) if a != b]
    files = {r["place"]["file"] for r in rows}
    assert len(starts) <= len(set(order)) + len(files)


def test_shards_are_written_in_zstd(spark, paths):
    assert all(name.endswith(".zstd.parquet") for name in spark.read.parquet(paths[0]).inputFiles())


def test_parts_hold_whole_slices(spark):
    dates = [year_start_ns(y) for y in (2000, 2000, 2001, 2003, 2003, 2003, 2005, 2006)]
    papers = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "id bigint, publication_date_int bigint")
    assert year_parts(papers, 2000, 2007, 1, 10, 30) == [(2000, 2003), (2003, 2005), (2005, 2007)]
    assert year_parts(papers, 2000, 2007, 1, 10, 10) == [(2000, 2001), (2001, 2003), (2003, 2004), (2004, 2006), (2006, 2007)]
    assert year_parts(papers, 2000, 2007, 2, 10, 1000) == [(2000, 2008)]
    assert year_parts(papers, 2010, 2012, 1, 10, 10) == [(2010, 2012)]
    assert year_parts(papers, 2000, 2000, 1, 10, 10) == [(2000, 2000)]


def test_an_export_in_parts_equals_one_write(spark, sf, paths, monkeypatch):
    args = views.labelled_papers(spark, sf), views.vectors(spark, sf), 1995, 2002, 1, B, K, N, ["above_mean"]
    parts = []
    monkeypatch.setattr("citeframe.plans.export.write_shards", lambda rows, *a, **b: (parts.append(rows), shards.write_shards(rows, *a, **b)))
    out = scratch.new_path(spark, "examples"), scratch.new_path(spark, "manifest")
    rows = lambda path: sorted(map(tuple, shards.read_shards(spark, path, K, N).collect()), key=lambda r: r[0])
    want, manifest = rows(paths[0]), sorted(map(tuple, shards.read_manifest(spark, paths[1]).collect()))
    # The second time on top of the first, of everything and then of some slices.
    for overwrite, years in ((True, (1995, 2002)), (True, (1995, 2002)), (False, (1997, 2000))):
        parts.clear()
        made = sharded_parts(*args[:2], *years, *args[4:], part_bytes=600 * (K + 1) * N * 4)
        export(made, *out, B, overwrite=overwrite, years=years)
        assert len(parts) > 1
        assert rows(out[0]) == want
        assert sorted(map(tuple, shards.read_manifest(spark, out[1]).collect())) == manifest
