"""Publication-time slices and the shards inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions.timeline import ceil_div, ceil_div_col, year_of_ns, year_start_ns, year_to_ns
from citeframe.operators.running import MAX_ROWS_PER_TASK, numbered


def time_slices(
    papers: DataFrame, start_year: int, end_year: int, delta: int = 1, date_col: str = "publication_date_int"
) -> DataFrame:
    """Adds ``slice_start`` and ``slice_end`` (epoch ns) of the half-open slice a paper falls in.

    Slices start every ``delta`` years from ``start_year`` while before ``end_year``; the last one may
    reach beyond it. Papers outside all slices drop. The range filter reaches the file scan.
    """
    n = ceil_div(end_year - start_year, delta)
    date = F.col(date_col)
    inside = papers.where(
        (date >= F.lit(year_start_ns(start_year))) & (date < F.lit(year_start_ns(start_year + n * delta)))
    )
    steps = F.call_function("div", year_of_ns(date) - F.lit(start_year), F.lit(delta)).cast("int")
    first = F.lit(start_year) + steps * F.lit(delta)
    return inside.withColumns(
        {"slice_start": year_to_ns(first), "slice_end": year_to_ns(first + F.lit(delta))}
    )


def assign_shards(
    sliced: DataFrame,
    rows_per_shard: int,
    id_col: str = "id",
    max_rows: int = MAX_ROWS_PER_TASK,
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds ``shard``: consecutive blocks of ``rows_per_shard`` papers of a slice in id order."""
    rows = numbered(sliced, ["slice_start"], [F.col(id_col)], "_row", n_chunks, max_rows)
    shard = F.call_function("div", F.col("_row") - 1, F.lit(rows_per_shard)).cast("int")
    return rows.withColumn("shard", shard).drop("_row")


def shard_counts(sharded: DataFrame) -> DataFrame:
    """Manifest rows ``(slice_start, slice_end, shard, n_examples)``."""
    return sharded.groupBy("slice_start", "slice_end", "shard").agg(F.count("*").alias("n_examples"))


def select_shards(manifest: DataFrame, t_min: int, t_max: int, boundary: str = "overlap") -> DataFrame:
    """Manifest rows whose slice meets ``[t_min, t_max]``.

    ``overlap`` is the closed test (a slice that only touches a bound counts); ``exclusive`` asks for
    a shared instant of the half-open intervals.
    """
    return manifest.where(meets(t_min, t_max, boundary))


def meets(t_min: int, t_max: int, boundary: str) -> Column:
    """Whether a row's slice meets a time range, see :func:`select_shards`."""
    start, end = F.col("slice_start"), F.col("slice_end")
    if boundary == "overlap":
        return (end >= F.lit(t_min)) & (start <= F.lit(t_max))
    if boundary == "exclusive":
        return (end > F.lit(t_min)) & (start < F.lit(t_max))
    raise ValueError(f"unknown boundary {boundary!r}")


def example_count(manifest: DataFrame, t_min: int, t_max: int, batch_size: int, boundary: str = "overlap") -> DataFrame:
    """One row: examples in the chosen shards and the batches one pass over them takes."""
    total = F.coalesce(F.sum("n_examples"), F.lit(0).cast("bigint"))
    steps = ceil_div_col(total, batch_size)
    chosen = select_shards(manifest, t_min, t_max, boundary)
    return chosen.agg(total.alias("n_examples"), steps.alias("n_batches"))
