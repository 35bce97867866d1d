"""The command-line jobs in a row: raw text to metric files."""

import pytest
from pyspark.sql import functions as F

from citeframe import jobs
from citeframe.functions import vectors as vec
from citeframe.functions.references import format_reference_list
from citeframe.plans import views
from citeframe.sources import scratch, shards

COLS = ["--n-features", "8"]


@pytest.fixture(scope="module")
def raw(spark, sf):
    """Papers as they come: list text, wide embeddings, one label."""
    path = scratch.new_path(spark, "raw")
    short = views.vectors(spark, sf).select("id", F.slice("embedding", 1, 8).alias("embedding"))
    rows = views.labelled_papers(spark, sf).join(short, "id").select(
        F.col("id").alias(jobs.ID_COL), format_reference_list(F.col("refs")).alias(jobs.REFS_COL), jobs.DATE_COL,
        F.col("above_mean").alias(jobs.LABELS[0]), *vec.unpack("embedding", 8),
    )
    rows.write.parquet(path)
    return path


def test_convert_export_train(spark, sf, raw):
    names = ("papers", "examples", "manifest", "metrics", "curves", "models")
    papers, examples, manifest, metrics, curves, models = (scratch.new_path(spark, n) for n in names)
    jobs.run(["convert", raw, papers, *COLS], spark)
    assert spark.read.parquet(papers).dtypes[:4] == [
        (jobs.ID_COL, "bigint"), (jobs.REFS_COL, "array<bigint>"), (jobs.DATE_COL, "bigint"), (jobs.LABELS[0], "int"),
    ]

    jobs.run(["export", papers, examples, manifest, "--timepoints", "3", "--shard-bytes", "409600", "--overwrite", *COLS], spark)
    assert shards.read_manifest(spark, manifest).agg(F.sum("n_examples"), F.max("n_examples")).first() == (1500, 100)

    folds = ["--start-year", "1995", "--end-year", "2002", "--start-train", "2", "--val-size", "1"]
    jobs.run(["train", examples, metrics, curves, models, "--timepoints", "3", "--trials", "2", "--max-iter", "5", *folds, *COLS], spark)
    rows = spark.read.option("header", True).schema(f"{shards.METRIC_SCHEMA}, span string").csv(metrics).collect()
    assert sorted(r["span"] for r in rows) == ["1998-1999", "1999-2000", "2000-2001"]
    tested = {r["fold"]: r["n"] for r in rows}
    want = views.scored_folds(spark, sf).where("y is not null").groupBy("fold").count().collect()
    assert tested == {r["fold"]: r["count"] for r in want}
    ends = spark.read.parquet(curves).where("threshold is null").collect()
    assert sorted(r["fold"] for r in ends) == [1999, 2000, 2001]


def test_repeated_ids_stop_the_export(spark, raw):
    twice = scratch.new_path(spark, "twice")
    df = spark.read.parquet(raw).withColumn(jobs.REFS_COL, F.array().cast("array<bigint>"))
    df.unionByName(df).write.parquet(twice)
    out = scratch.new_path(spark, "examples"), scratch.new_path(spark, "manifest")
    with pytest.raises(ValueError, match="appears 2 times"):
        jobs.run(["export", twice, *out, *COLS], spark)


def test_defaults_are_the_usual_settings():
    args = jobs._parser().parse_args(["export", "a", "b", "c"])
    assert (args.timepoints, args.n_features, args.years) == (50, 384, [1900, 2024, 1])
    args = jobs._parser().parse_args(["train", "a", "b", "c", "d"])
    assert (args.start_train, args.val_size, args.test_size, args.trials) == (100, 5, 1, 50)
