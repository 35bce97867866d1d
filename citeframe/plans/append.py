"""An export that grows with its papers: new papers, and the older examples that they change.

A paper that arrives may be one that older papers already cite. Their examples held no step for it, as its reference was
dangling, so they change too, in any year. Every export therefore keeps its dangling references as an index ``(ref_id, id)``; the ids
that arrive are looked up there, and nothing of the older papers' lists is read. Only the examples found that way and the new ones
are built, only their steps' vectors are shuffled, and only their slices are written: the other examples of those slices
are copied from the last version, with new shard numbers where a slice has grown.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe.operators.citations import dangling_references
from citeframe.operators.keyfilter import key_blocks, may_hold
from citeframe.operators.sequences import build_examples
from citeframe.operators.slicing import assign_shards, time_slices
from citeframe.plans.export import sharded_parts
from citeframe.sources import published, scratch
from citeframe.sources.shards import SHARD_KEYS


@dataclass(frozen=True)
class Shape:
    """What all exports to one place share."""

    start_year: int
    end_year: int
    rows_per_shard: int
    timepoints: int
    n_features: int
    y_cols: Sequence[str] = ()
    delta: int = 1
    pad: float = 0.0


def _index_path(root: str, folder: str) -> str:
    return f"{root}/{folder}/dangling"


def first_export(papers: DataFrame, vectors: DataFrame, root: str, shape: Shape) -> int:
    """Publishes the examples of all papers, with the index of their dangling references; returns the version."""
    folder = published.new_folder(root)
    parts = sharded_parts(
        papers, vectors, shape.start_year, shape.end_year, shape.delta, shape.rows_per_shard, shape.timepoints, shape.n_features,
        shape.y_cols, shape.pad, filter_vectors=False,
    )
    dangling_references(papers, papers).write.parquet(_index_path(root, folder))
    published.write_part(parts, root, folder, shape.rows_per_shard)
    return published.commit(papers.sparkSession, root, folder)


def dangling_index(spark: SparkSession, root: str) -> DataFrame:
    """(ref_id, id) of references that named no paper when their paper was exported, of all versions.

    Those that were resolved since stay: an id arrives once."""
    folders = [r["folder"] for r in published.commits(spark, root).select("folder").distinct().collect()]
    return reduce(DataFrame.unionByName, [spark.read.parquet(_index_path(root, f)) for f in sorted(folders)])


def stale_examples(spark: SparkSession, root: str, new_ids: DataFrame) -> DataFrame:
    """Ids of exported papers that cite one of ``new_ids`` (id)."""
    arrived = new_ids.select(F.col("id").alias("ref_id"))
    return dangling_index(spark, root).join(arrived, "ref_id", "left_semi").select("id").distinct()


def _renumbered(stored: DataFrame, shards: DataFrame) -> DataFrame:
    """The rows of ``stored.drop("shard").join(shards, "id")``, laid out by their new shard and sorted; wide rows are shuffled once.

    The join is made on ids alone, and written. It says which new shards an old one goes to and within which ids: some rows for
    each shard, which are broadcast, so that a stored row finds its new shard where it is read. Rows without one stay behind by a filter
    of fixed size (``operators/keyfilter``) on their ids, and the few that pass it are left out next to the ids of the join.
    """
    spark, path = stored.sparkSession, scratch.new_path(stored.sparkSession, "moves")
    here = [*SHARD_KEYS[:2], "_from"]
    stored = stored.withColumnRenamed("shard", "_from")
    moves = stored.select("id", *here).join(shards, "id")
    with scratch.dropping_shuffles(spark):
        moves.write.parquet(path)
    moves = spark.read.schema(moves.schema).parquet(path)
    pairs = moves.groupBy(*here, "shard", "id").agg(F.count("*").alias("_pairs"))
    ways = pairs.groupBy(*here, "shard").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.max("_pairs").alias("_most"))
    going = may_hold(stored, "id", key_blocks(moves, "id")).join(F.broadcast(ways), here)
    going = going.where(F.col("id").between(F.col("_low"), F.col("_high")))
    # A repeated id has a row for each pair, as in the join; the others have one.
    going = going.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_most"))).drop("_low", "_high", "_most")
    met = going.unionByName(moves.withColumn("_pair", F.lit(1)), allowMissingColumns=True)
    one = Window.partitionBy(*SHARD_KEYS, "_from", "id")
    n_stored, n_pairs = F.sum((F.col("_copy") == 1).cast("int")).over(one), F.sum("_pair").over(one)
    rows = met.repartition(*SHARD_KEYS).withColumns({"_stored": n_stored, "_pairs": n_pairs})
    return rows.where(F.col("_copy") * F.col("_stored") <= F.col("_pairs")).select(*stored.drop("_from").columns, "shard")


def append_papers(papers: DataFrame, new_ids: DataFrame, vectors: DataFrame, root: str, shape: Shape) -> int:
    """Publishes the version that a full export of ``papers``, the new ones included, would give; returns its number.

    ``new_ids`` (id) are the papers that were not there at the last version. At most one row per slice reaches the driver."""
    spark = papers.sparkSession
    changed = new_ids.select("id").union(stale_examples(spark, root, new_ids)).distinct().withColumn("_changed", F.lit(True))
    sliced = time_slices(papers, shape.start_year, shape.end_year, shape.delta)
    touched = [r[0] for r in sliced.join(changed, "id", "left_semi").select("slice_start").distinct().collect()]
    if not touched:
        return published.last_version(spark, root)
    numbered = assign_shards(sliced.where(F.col("slice_start").isin(touched)), shape.rows_per_shard)
    numbered = numbered.join(changed, "id", "left")
    focal = numbered.where("_changed").drop("_changed")
    built = build_examples(
        papers, vectors, shape.timepoints, shape.n_features, shape.y_cols, shape.pad, focal=focal, group_keys=SHARD_KEYS,
        filter_vectors=True,
    )
    parts, old = [built], published.version_slices(spark, root).where(F.col("slice_start").isin(touched))
    if not old.isEmpty():
        stored = published.read_published(spark, root, shape.timepoints, shape.n_features, slices=old)
        parts.append(_renumbered(stored, numbered.where("_changed IS NULL").select("id", "shard")).select(*built.columns))
    folder = published.new_folder(root)
    fresh = papers.join(new_ids.select("id"), "id", "left_semi")
    dangling_references(fresh, papers).write.parquet(_index_path(root, folder))
    published.write_part(parts, root, folder, shape.rows_per_shard)
    return published.commit(spark, root, folder)
