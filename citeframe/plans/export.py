"""Slices, shards, examples and manifest of a papers table in one write job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.functions.timeline import FLOAT_BYTES, ceil_div, year_start_ns
from citeframe.operators.running import MAX_ROWS_PER_TASK
from citeframe.operators.sequences import build_examples
from citeframe.operators.slicing import assign_shards, time_slices
from citeframe.sources.shards import SHARD_KEYS, write_manifest, write_shards

#: Example vectors that one write of an export holds in its shuffle files, about; a slice is never cut.
PART_BYTES = 16 * 1024**3


def sharded_examples(
    papers: DataFrame,
    vectors: DataFrame,
    start_year: int,
    end_year: int,
    delta: int,
    rows_per_shard: int,
    timepoints: int,
    n_features: int,
    y_cols: Sequence[str] = (),
    pad: float = 0.0,
    max_rows: int = MAX_ROWS_PER_TASK,
    filter_vectors: bool = True,
    **options,
) -> DataFrame:
    """Examples of all slices with their shard, laid out by shard.

    Shards are numbered on thin paper rows. The vector rows are then shuffled once, by shard, which
    both the assembly and the partitioned write use. Slices above ``max_rows`` papers are numbered in chunks.
    The vector scan is filtered by the steps of these years before that shuffle (see ``build_examples``); an export of
    the whole table needs no ``filter_vectors``.
    """
    sharded = assign_shards(time_slices(papers, start_year, end_year, delta), rows_per_shard, max_rows=max_rows)
    return build_examples(
        papers, vectors, timepoints, n_features, y_cols, pad, focal=sharded, group_keys=SHARD_KEYS,
        filter_vectors=filter_vectors, **options,
    )


def year_parts(
    papers: DataFrame, start_year: int, end_year: int, delta: int, example_bytes: int, part_bytes: int = PART_BYTES
) -> list[tuple[int, int]]:
    """``(start, end)`` years of neighbouring slices whose examples fill at most ``part_bytes``; a larger slice is a part of its own.

    One count over the dates; the driver gets a row per slice."""
    counts = time_slices(papers, start_year, end_year, delta).groupBy("slice_start").agg(F.count("*").alias("n")).collect()
    n_papers, parts, held = {r["slice_start"]: r["n"] for r in counts}, [], 0
    for i in range(ceil_div(end_year - start_year, delta)):
        year = start_year + i * delta
        size = n_papers.get(year_start_ns(year), 0) * example_bytes
        if parts and held + size <= part_bytes:
            parts[-1], held = (parts[-1][0], year + delta), held + size
        else:
            parts.append((year, year + delta))
            held = size
    return parts or [(start_year, end_year)]


def sharded_parts(
    papers: DataFrame,
    vectors: DataFrame,
    start_year: int,
    end_year: int,
    delta: int,
    rows_per_shard: int,
    timepoints: int,
    n_features: int,
    y_cols: Sequence[str] = (),
    pad: float = 0.0,
    filter_vectors: bool = True,
    part_bytes: int = PART_BYTES,
    **options,
) -> Iterator[DataFrame]:
    """:func:`sharded_examples` in parts of whole slices, to be written one after the other.

    All steps of an export, with their vectors, lie in shuffle files until it is written. A part's files are deleted when it is
    written, so the disk holds those of one part and the shards. Each part looks its references up in the whole table."""
    width = (timepoints + 1) * n_features * FLOAT_BYTES
    years = year_parts(papers, start_year, end_year, delta, width, part_bytes)
    for first, end in years:
        yield sharded_examples(
            papers, vectors, first, end, delta, rows_per_shard, timepoints, n_features, y_cols, pad,
            filter_vectors=filter_vectors or len(years) > 1, **options,
        )


def export(
    examples: DataFrame | Iterable[DataFrame], examples_path: str, manifest_path: str, rows_per_shard: int, overwrite: bool = False,
    years: tuple[int, int] | None = None,
) -> None:
    """Writes the examples of :func:`sharded_examples`, or its parts (:func:`sharded_parts`), and the manifest of what was written.
    ``years``, their first year and the one behind their last, spares an incremental export the count of all other slices."""
    for i, part in enumerate([examples] if isinstance(examples, DataFrame) else examples):
        write_shards(part, examples_path, rows_per_shard, overwrite and not i, append=overwrite and i > 0)
    low, high = (year_start_ns(y) for y in years) if years else (None, None)
    write_manifest(part.sparkSession, examples_path, manifest_path, overwrite, low, high)
