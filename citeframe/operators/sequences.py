"""Fixed-width examples: the oldest references of a paper, padded on the left, then the paper itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeframe.functions.vectors import assemble, clean_vector, pad_vector, target_vector
from citeframe.operators.citations import rank_references, reference_dates
from citeframe.operators.keyfilter import key_blocks, may_hold
from citeframe.operators.skew import hot_keys, lookup_join, splits_skew
from citeframe.sources.datasets import scan_in, scan_range

# Ids of at most this many steps, 8 bytes each, may be broadcast.
MAX_BROADCAST_KEYS = 2_000_000


def build_examples(
    papers: DataFrame,
    vectors: DataFrame,
    timepoints: int,
    n_features: int,
    y_cols: Sequence[str] = (),
    pad: float = 0.0,
    focal: DataFrame | None = None,
    low: int | None = None,
    high: int | None = None,
    group_keys: Sequence[str] = (),
    id_col: str = "id",
    refs_col: str = "refs",
    date_col: str = "publication_date_int",
    vector_col: str = "embedding",
    fill_labels: float | None = None,
    hot: Mapping[int, int] | None = None,
    broadcast_keys: int = MAX_BROADCAST_KEYS,
    filter_vectors: bool | None = None,
) -> DataFrame:
    """One row ``(group_keys, id, date, features, target)`` per focal paper.

    ``papers`` is the whole table that references are looked up in; the focal papers are its rows
    with ``low <= date < high`` (or the rows of ``focal``, which may carry ``group_keys``).

    Every paper is also its own step, ranked before its references. So papers and references share one
    scan, one date lookup and one vector lookup, a paper without references needs no outer join, and one
    descending sort of at most ``timepoints + 1`` steps gives the final layout.
    With ``group_keys`` (a shard, say) the only shuffle of vector rows is by those keys, which is also
    the layout a partitioned write wants. Without them the examples lie by paper, as the vectors do after their
    shuffle, so only the vectors of references are sent on: a paper meets its own vector where it already lies. A filtered scan
    is looked up in once, for papers and references together, so that its filter is built once.
    For a part of the papers the vector scan is filtered before its shuffle: when the steps of a
    date range number at most ``broadcast_keys``, which is counted first, by their ids; otherwise by a filter of fixed size
    (``operators/keyfilter``) built from the steps that are left after dates and ranks. ``filter_vectors`` turns it on for
    ``focal`` papers that are a part of the table, or off.
    ``hot`` names much-cited papers to spread (see ``operators/skew``); by default the session decides.
    """
    keys = list(group_keys)
    focal = papers if focal is None else focal
    cols = list(dict.fromkeys([*keys, id_col, date_col, refs_col, *y_cols]))
    if low is not None or high is not None:
        focal = scan_range(focal, cols, _min(low), _max(high), date_col)
    else:
        focal = focal.select(*cols)

    none = F.array().cast("array<bigint>")
    listed = F.concat(F.array(F.col(id_col)), F.coalesce(F.col(refs_col), none))
    steps = focal.select(
        *keys,
        F.col(id_col).alias("id"),
        target_vector(y_cols, fill_labels).alias("target"),
        F.posexplode(listed).alias("_pos", "ref_id"),
    )
    own = F.col("_pos") == 0
    steps = steps.withColumns({"_is_ref": ~own, "target": F.when(own, F.col("target"))})
    if hot is None:
        hot = {} if splits_skew(focal.sparkSession) else hot_keys(focal.select(F.explode(refs_col).alias("ref_id")), "ref_id")
    dated = reference_dates(steps.drop("_pos"), papers, id_col, date_col, hot)
    if keys:
        # Steps with keys are wider. A cut ahead of the shuffle by paper would sort them while the lookup of the dates holds its own sort.
        dated = dated.repartition("id")
    ranked = rank_references(dated, timepoints + 1, first=[F.col("_is_ref")])
    ranked = ranked.withColumn("own_date", F.when(~F.col("_is_ref"), F.col("ref_date"))).drop("ref_date")

    needed, in_range = vectors, low is not None or high is not None
    if filter_vectors is None:
        filter_vectors = in_range
    if filter_vectors and not (in_range and steps.count() <= broadcast_keys):
        needed = may_hold(vectors, id_col, key_blocks(ranked, "ref_id"))
    elif filter_vectors:
        needed = scan_in(vectors, vectors.columns, F.broadcast(steps.select("ref_id")), id_col)
    lookup = needed.select(
        F.col(id_col).alias("ref_id"), clean_vector(F.col(vector_col), n_features, pad).alias("embedding")
    )
    filled = F.coalesce("embedding", pad_vector(n_features, pad))
    if keys or filter_vectors:
        placed = lookup_join(ranked, lookup, "ref_id", "id", "left", hot).withColumn("embedding", filled)
        grouped = _in_order(placed.repartition(*keys), *keys, "id") if keys else _grouped(placed, "id")
    else:
        refs = lookup_join(ranked.where("_is_ref"), lookup, "ref_id", "id", "left", hot)
        # The same columns of both parts, so that they share the shuffles of the ranks and, without hot keys, of the vectors.
        at_home = lookup.withColumnRenamed("ref_id", "_at")
        own = ranked.where(~F.col("_is_ref")).join(at_home, F.col("id") == F.col("_at"), "left")
        # Vectors of one paper come from many tasks, so grouping them before the shuffle would sort them for nothing.
        own, refs = (_grouped(part.withColumn("embedding", filled), "id") for part in (own, refs.repartition("id")))
        grouped = _side_by_side(own, refs)
    return grouped.select(
        *keys,
        F.col("id").alias(id_col),
        F.col("date").alias(date_col),
        assemble(F.col("steps.embedding"), timepoints, n_features, pad).alias("features"),
        "target",
    )


def _grouped(placed: DataFrame, *by: str) -> DataFrame:
    """The steps of each example, newest rank first, with the target and date that its own step carries."""
    return placed.groupBy(*by).agg(
        F.max("target").alias("target"),
        F.max("own_date").alias("date"),
        F.sort_array(F.collect_list(F.struct("ref_rank", "embedding")), asc=False).alias("steps"),
    )


def _in_order(placed: DataFrame, *by: str) -> DataFrame:
    """The rows of :func:`_grouped`, sorted by ``by``; of the steps the vectors alone.

    The steps are sorted once and read in that order. A grouping would sort them twice and leave the examples in no order, so that a
    partitioned write sorts them again.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("ref_rank"), F.desc("embedding"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = placed.select(
        *by,
        F.max("target").over(whole).alias("target"),
        F.max("own_date").over(whole).alias("date"),
        F.struct(F.collect_list("embedding").over(whole).alias("embedding")).alias("steps"),
        F.row_number().over(w).alias("_n"),
    )
    return rows.where(F.col("_n") == 1).drop("_n")


def _side_by_side(own: DataFrame, refs: DataFrame) -> DataFrame:
    """Own and cited steps of each example in one row; either may be missing.

    Cited steps have no target and no date. These are read all the same, or the two parts would not share their shuffles.
    """
    none = F.array().cast(own.schema["steps"].dataType)
    cited = refs.toDF("_of", "_target", "_date", "_cited")
    steps = F.concat(F.coalesce("_cited", none), F.coalesce("steps", none))
    return own.join(cited, F.col("id") == F.col("_of"), "full").select(
        F.coalesce("id", "_of").alias("id"), F.coalesce("target", "_target").alias("target"),
        F.coalesce("date", "_date").alias("date"), F.sort_array(steps, asc=False).alias("steps"),
    )


def _min(low: int | None) -> int:
    return -(2**63) if low is None else low


def _max(high: int | None) -> int:
    return 2**63 - 1 if high is None else high
