"""Example shards as slice-partitioned Parquet, the count manifest and the metric files.

Directories are slices; the shard number is a column. Reading a time range prunes directories, the
number of directories does not grow with the data, and writing a slice again replaces it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.functions.timeline import FLOAT_BYTES, ceil_div
from citeframe.functions.vectors import checked_width
from citeframe.operators.slicing import meets, shard_counts
from citeframe.sources.scratch import dropping_shuffles

SLICE_KEYS = ("slice_start", "slice_end")
SHARD_KEYS = (*SLICE_KEYS, "shard")


def write_shards(examples: DataFrame, path: str, rows_per_shard: int, overwrite: bool = False, append: bool = False) -> None:
    """Writes examples below ``slice_start=/slice_end=``, at most ``rows_per_shard`` rows per file.

    ``overwrite`` drops the whole output first, ``append`` adds files to it; otherwise only the slices present are replaced. The sort is the
    one a partitioned write needs, with the shard added, so the rows of a shard lie together. The shuffle files behind the
    examples are deleted when they are written: a later step needs the disk.
    """
    writer = (
        examples.sortWithinPartitions(*SHARD_KEYS)
        .write.mode("append" if append else "overwrite")
        .option("partitionOverwriteMode", "static" if overwrite else "dynamic")
        .option("maxRecordsPerFile", rows_per_shard)
        # Embedding values hardly repeat, so a dictionary would only be built and thrown away.
        .option("parquet.enable.dictionary#features.list.element", "false")
        # A vector comes again in every example that cites its paper, beyond the reach of the default codec.
        .option("compression", "zstd")
    )
    with dropping_shuffles(examples.sparkSession):
        writer.partitionBy(*SLICE_KEYS).parquet(path)


def _slices_as_bigint(df: DataFrame) -> DataFrame:
    """Directory values near 1970 are short numbers, which a reader takes for int."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in SLICE_KEYS})


def write_manifest(
    spark: SparkSession, examples_path: str, manifest_path: str, overwrite: bool = False,
    low: int | None = None, high: int | None = None,
) -> None:
    """Counts the written shards and puts them in place of the same slices of the manifest.

    The count reads the ``shard`` column alone. It covers what is on storage, not what was planned. With ``low`` and
    ``high`` only slices that start in ``[low, high)`` are counted; files of the others are neither read nor rewritten.
    """
    stored = spark.read.parquet(examples_path)
    if not overwrite and low is not None and high is not None:
        stored = stored.where((F.col("slice_start") >= F.lit(low)) & (F.col("slice_start") < F.lit(high)))
    counts = shard_counts(_slices_as_bigint(stored.select(*SHARD_KEYS)))
    (
        counts.write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if overwrite else "dynamic")
        .partitionBy("slice_start")
        .parquet(manifest_path)
    )


def read_manifest(spark: SparkSession, manifest_path: str) -> DataFrame:
    return _slices_as_bigint(spark.read.parquet(manifest_path)).select(*SHARD_KEYS, "n_examples")


def read_shards(
    spark: SparkSession,
    path: str,
    timepoints: int,
    n_features: int,
    t_min: int | None = None,
    t_max: int | None = None,
    boundary: str = "exclusive",
    date_col: str = "publication_date_int",
) -> DataFrame:
    """Examples of a time range with their width checked; an error when no shard is selected.

    ``overlap`` takes whole slices that touch the closed range. ``exclusive`` prunes to the slices that
    share time with ``[t_min, t_max)`` and then filters by each example's own date.
    """
    df = spark.read.parquet(path)
    if t_min is not None and t_max is not None:
        df = df.where(meets(t_min, t_max, boundary))
        if boundary == "exclusive":
            df = df.where((F.col(date_col) >= F.lit(t_min)) & (F.col(date_col) < F.lit(t_max)))
    if df.select("shard").isEmpty():
        raise ValueError(f"no examples in {path} for this range")
    return _slices_as_bigint(df).withColumn("features", checked_width(F.col("features"), timepoints, n_features))


def wide_row_settings(
    n_examples: int, timepoints: int, n_features: int,
    task_bytes: int = 256 * 1024**2, batch_bytes: int = 64 * 1024**2,
) -> dict[str, str]:
    """Session settings for a job over ``n_examples``: shuffle partitions near ``task_bytes`` of example
    vectors (adaptive execution still joins small ones) and columnar batches near ``batch_bytes``."""
    width = (timepoints + 1) * n_features * FLOAT_BYTES
    return {
        "spark.sql.shuffle.partitions": str(max(200, ceil_div(n_examples * width, task_bytes))),
        "spark.sql.parquet.columnarReaderBatchSize": str(max(16, min(4096, batch_bytes // width))),
    }


def write_metrics(metrics: DataFrame, path: str, test_size: int, fold_col: str = "fold") -> None:
    """One CSV folder per fold, ``span={end - test_size}-{end}``."""
    span = F.concat_ws("-", (F.col(fold_col) - F.lit(test_size)).cast("string"), F.col(fold_col).cast("string"))
    metrics.withColumn("span", span).write.mode("overwrite").option("header", True).partitionBy("span").csv(path)


# Columns of a metric file; the fold comes first and ``span`` is in the folder name.
METRIC_SCHEMA = (
    "fold int, n bigint, loss double, accuracy double, balanced_accuracy double, precision double, recall double"
)
