"""Running aggregates, row numbers and short look-back windows that survive hot groups.

A window sends each group to one task. Where the largest group is above ``max_rows`` the operators here
lay the hot groups out by range of their sort order, total every range, and carry the totals of the earlier ranges of a group
into it, so no task sees more than a range. The other groups stay in a plain window. The results are the same
either way, for every type that sorts: numbers, strings, dates, times, with nulls and NaN where the sort puts them.

The ranges come from the exchange of Spark itself; only their number is given to it. The laid-out rows are written to the
shared folder, because the totals and the rows must come from the same ranges. Finding the hot groups and
writing them are jobs that run when the plan is built; with ``n_chunks`` given every group is cut. Rows that
are equal in all order columns stay together, so an order should end in a column that tells rows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from citeframe.sources import scratch

MAX_ROWS_PER_TASK = 2_000_000

_CHUNK = "_chunk"
_REAL = "_real"
_FUNCS = {"sum": F.sum, "max": F.max}


def chunks_needed(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS_PER_TASK) -> int:
    """1 when every group fits one task, else the number of chunks to cut the rows into.

    One map-side combined count over the key columns; only two numbers reach the driver.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    row = counts.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    if (row["top"] or 0) <= max_rows:
        return 1
    return max(2, -(-row["total"] // max_rows))


def _split_hot(df: DataFrame, keys: Sequence[str], max_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that fit one task, and those of the larger ones, of which there are few."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    hot = counts.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)])
    same = None
    for i, k in enumerate(keys):
        equal = F.col(k).eqNullSafe(F.col(f"_hot_{i}"))
        same = equal if same is None else same & equal
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def cut_into_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n_chunks: int) -> DataFrame:
    """The rows with ``_chunk``, which grows with the keys and the sort order inside them, read back from the shared folder."""
    dealt = df.repartitionByRange(n_chunks, *[F.col(k) for k in keys], *order).withColumn(_CHUNK, F.spark_partition_id())
    path = scratch.new_path(df.sparkSession, "ranges")
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, tuple[str, Column]],
    before: bool = False,
    n_chunks: int | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
    totals: bool = False,
) -> DataFrame:
    """Adds a running ``sum`` or ``max`` per measure (``name -> (function, expression)``).

    The value covers the rows up to and including the current one, or only the earlier ones with
    ``before=True`` (null for the first row). ``totals`` also adds ``{name}_total``, the value over the whole
    group. ``n_chunks=None`` decides by counting the groups.
    """
    keys = list(keys)
    if n_chunks is None:
        n_chunks = chunks_needed(df, keys, max_rows)
        if n_chunks > 1 and keys:
            rest, hot = _split_hot(df, keys, max_rows)
            how = keys, order, measures, before
            n_hot = chunks_needed(hot, keys, max_rows)
            return running(rest, *how, 1, max_rows, totals).unionByName(running(hot, *how, n_hot, max_rows, totals))
    last = -1 if before else Window.currentRow
    if n_chunks == 1:
        group = Window.partitionBy(*keys)
        w = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        added = {name: _FUNCS[f](e).over(w) for name, (f, e) in measures.items()}
        if totals:
            added |= {f"{name}_total": _FUNCS[f](e).over(group) for name, (f, e) in measures.items()}
        return df.withColumns(added)

    cut = cut_into_chunks(df, keys, order, n_chunks)
    rows = cut.withColumns({_REAL: F.lit(1), **{f"_v_{name}": e for name, (_, e) in measures.items()}})

    # One row per (group, chunk), combined before the shuffle; a group has at most n_chunks of them.
    # It opens its chunk with the totals of the group's earlier chunks, so no join is needed.
    parts = cut.groupBy(*keys, _CHUNK).agg(*[_FUNCS[f](e).alias(name) for name, (f, e) in measures.items()])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    openers = {_REAL: F.lit(0), **{f"_v_{name}": _FUNCS[f](F.col(name)).over(earlier) for name, (f, _) in measures.items()}}
    if totals:
        openers |= {f"_t_{name}": _FUNCS[f](F.col(name)).over(group) for name, (f, _) in measures.items()}
    opening = parts.select(*keys, _CHUNK, *[column.alias(name) for name, column in openers.items()])

    inside = Window.partitionBy(*keys, _CHUNK).orderBy(_REAL, *order).rowsBetween(Window.unboundedPreceding, last)
    added = {name: _FUNCS[f](F.col(f"_v_{name}")).over(inside) for name, (f, _) in measures.items()}
    if totals:
        first = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added |= {f"{name}_total": F.first(f"_t_{name}").over(first) for name in measures}
    both = rows.unionByName(opening, allowMissingColumns=True).withColumns(added)
    return both.where(F.col(_REAL) == 1).select(*df.columns, *added)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_num",
    n_chunks: int | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
    totals: bool = False,
) -> DataFrame:
    """Adds 1-based row numbers per group, without sending a hot group to one task.

    ``totals`` also adds ``{name}_total``, the number of rows of the group.
    """
    one = {name: ("sum", F.lit(1).cast("bigint"))}
    return running(df, keys, order, one, False, n_chunks, max_rows, totals)


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    reach: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    n_chunks: int | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Adds window columns that look at most ``reach`` rows back inside their group.

    ``add(df, w)`` adds the columns over an ordered window specification. For hot groups the rows are
    numbered and cut every ``max_rows`` rows, and each piece also receives the last ``reach`` rows of
    the piece before it, which are dropped again.
    """
    keys = list(keys)
    if n_chunks is None:
        n_chunks = chunks_needed(df, keys, max_rows)
        if n_chunks > 1 and keys:
            rest, hot = _split_hot(df, keys, max_rows)
            n_hot = chunks_needed(hot, keys, max_rows)
            cut = look_back(hot, keys, order, reach, add, n_hot, max_rows)
            return look_back(rest, keys, order, reach, add, 1, max_rows).unionByName(cut)
    if n_chunks == 1:
        return add(df, Window.partitionBy(*keys).orderBy(*order))

    size = max(max_rows, reach)
    rows = numbered(df, keys, order, "_row", n_chunks)
    own = F.call_function("div", F.col("_row") - 1, F.lit(size))
    shared = F.pmod(F.col("_row") - 1, F.lit(size)) >= size - reach
    spread = rows.withColumn("_own", own).withColumn(
        "_piece", F.explode(F.when(shared, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    out = add(spread, Window.partitionBy(*keys, "_piece").orderBy("_row"))
    return out.where(F.col("_piece") == F.col("_own")).drop("_row", "_own", "_piece")
