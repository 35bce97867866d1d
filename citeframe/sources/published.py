"""Versions of an example export: a reader sees all of a version or nothing of it.

An export writes its slices, their counts and whatever goes with them into a folder of its own. A version then names the folder
of every slice, in rows ``(version, slice_start, slice_end, folder, n_shards, n_examples)`` of one table, and is one
file of it: it appears whole, or not at all where the writer stops before. Slices that a version does not replace keep the
folder they had, so nothing that a reader may be reading is rewritten. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.functions.vectors import checked_width
from citeframe.operators.slicing import meets
from citeframe.sources.shards import SHARD_KEYS, read_manifest, write_manifest, write_shards

COMMITS = "version int, slice_start bigint, slice_end bigint, folder string, n_shards bigint, n_examples bigint"


def new_folder(root: str) -> str:
    """The name of an unused folder below ``root``."""
    return f"part-{uuid.uuid4().hex}"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All versions; empty before the first."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{root}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def last_version(spark: SparkSession, root: str) -> int:
    return commits(spark, root).agg(F.max("version")).first()[0] or 0


def version_slices(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The slices of a version, the newest unless told otherwise."""
    version = last_version(spark, root) if version is None else version
    return commits(spark, root).where(F.col("version") == version)


def write_part(parts: Iterable[DataFrame], root: str, folder: str, rows_per_shard: int) -> None:
    """Shards and counts of one folder, not seen by any reader yet. The examples come in one or more parts, each laid out by
    shard; they are written one after the other, so that their shuffle files are never on disk together."""
    path = f"{root}/{folder}/examples"
    for i, examples in enumerate(parts):
        write_shards(examples, path, rows_per_shard, overwrite=not i, append=bool(i))
    write_manifest(examples.sparkSession, path, f"{root}/{folder}/manifest", overwrite=True)


def commit(spark: SparkSession, root: str, folder: str) -> int:
    """Publishes the slices of a written folder beside the other slices of the last version; returns the new version.

    A folder without any example leaves the version as it is."""
    last = last_version(spark, root)
    counted = read_manifest(spark, f"{root}/{folder}/manifest").groupBy("slice_start", "slice_end").agg(
        F.count("*").alias("n_shards"), F.sum("n_examples").alias("n_examples")
    )
    if counted.isEmpty():
        return last
    now = counted.select("slice_start", "slice_end", F.lit(folder).alias("folder"), "n_shards", "n_examples")
    # At most one row per slice.
    others = version_slices(spark, root, last).join(now, ["slice_start", "slice_end"], "left_anti").select(now.columns)
    rows = now.unionByName(others).select(F.lit(last + 1).alias("version"), "*")
    rows.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return last + 1


def publish(examples: DataFrame, root: str, rows_per_shard: int) -> int:
    """Writes examples and publishes them as the next version."""
    folder = new_folder(root)
    write_part([examples], root, folder, rows_per_shard)
    return commit(examples.sparkSession, root, folder)


def _folders(slices: DataFrame) -> list[tuple[str, list[int]]]:
    """Folders of a version with their slices; a version has one row per slice."""
    rows = slices.groupBy("folder").agg(F.sort_array(F.collect_list("slice_start")).alias("starts")).orderBy("folder").collect()
    return [(r["folder"], r["starts"]) for r in rows]


def _gathered(parts: Iterable[DataFrame], empty: str) -> DataFrame:
    found = list(parts)
    if not found:
        raise ValueError(empty)
    return reduce(DataFrame.unionByName, found)


def published_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Manifest rows ``(slice_start, slice_end, shard, n_examples)`` of a version."""
    slices = version_slices(spark, root, version)
    parts = (
        read_manifest(spark, f"{root}/{folder}/manifest").where(F.col("slice_start").isin(starts))
        for folder, starts in _folders(slices)
    )
    return _gathered(parts, f"nothing is published in {root}")


def read_published(
    spark: SparkSession, root: str, timepoints: int, n_features: int, t_min: int | None = None, t_max: int | None = None,
    boundary: str = "exclusive", version: int | None = None, date_col: str = "publication_date_int", slices: DataFrame | None = None,
) -> DataFrame:
    """Examples of a version, of a time range as in :func:`citeframe.sources.shards.read_shards`, or of chosen rows of
    :func:`version_slices`."""
    chosen = version_slices(spark, root, version) if slices is None else slices
    if t_min is not None and t_max is not None:
        chosen = chosen.where(meets(t_min, t_max, boundary))
    parts = []
    for folder, starts in _folders(chosen):
        stored = spark.read.parquet(f"{root}/{folder}/examples")
        parts.append(stored.where(F.col("slice_start").isin(starts)).withColumns({c: F.col(c).cast("bigint") for c in SHARD_KEYS[:2]}))
    rows = _gathered(parts, f"no examples in {root} for this range")
    if t_min is not None and t_max is not None and boundary == "exclusive":
        rows = rows.where((F.col(date_col) >= F.lit(t_min)) & (F.col(date_col) < F.lit(t_max)))
    return rows.withColumn("features", checked_width(F.col("features"), timepoints, n_features))
