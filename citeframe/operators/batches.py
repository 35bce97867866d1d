"""Training batches: reproducible shuffled order and batch numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.operators.running import MAX_ROWS_PER_TASK, numbered

SEED = 2025


def shuffle_key(id_col: str = "id", seed: int = SEED) -> Column:
    """A 52-bit pseudo-random integer fixed by the id and the seed."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def batch_ids(
    examples: DataFrame,
    batch_size: int,
    seed: int | None = None,
    drop_remainder: bool = False,
    keys: Sequence[str] = (),
    id_col: str = "id",
    max_rows: int = MAX_ROWS_PER_TASK,
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds ``batch_id`` in id order, or in the seeded shuffle order when a seed is given.

    With ``drop_remainder`` the last partial batch of a group is left out.
    """
    keys = list(keys)
    position = F.col(id_col) if seed is None else shuffle_key(id_col, seed)
    keyed = examples.withColumn("_order", position)
    order = [F.col("_order"), F.col(id_col)]
    rows = numbered(keyed, keys, order, "_row", n_chunks, max_rows, totals=drop_remainder)
    out = rows.withColumn("batch_id", F.call_function("div", F.col("_row") - 1, F.lit(batch_size)))
    if drop_remainder:
        out = out.where(F.col("batch_id") < F.call_function("div", F.col("_row_total"), F.lit(batch_size)))
    return out.select(*examples.columns, "batch_id")
