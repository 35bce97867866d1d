"""The citation graph as thin edges: explode, resolve against the papers, rank by date.

An edge row is two or three integers. Vectors join only after the rank cut, so the shuffles here
stay small. A much-cited paper is a hot key only on the edge side of an equi-join with unique ids, and
nothing between such a join and the next exchange needs its partitioning; see ``operators/skew``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.operators.skew import lookup_join


def explode_references(
    papers: DataFrame, id_col: str = "id", refs_col: str = "refs", keep: Sequence[str] = ()
) -> DataFrame:
    """One row ``(id, ref_id)`` per listed reference; repeats stay, null and empty lists vanish."""
    return papers.select(F.col(id_col).alias("id"), *keep, F.explode(refs_col).alias("ref_id"))


def available_references(
    edges: DataFrame, papers: DataFrame, id_col: str = "id", hot: Mapping[int, int] | None = None
) -> DataFrame:
    """Edges whose reference is a paper of the table."""
    known = papers.select(F.col(id_col).alias("ref_id"))
    return lookup_join(edges, known, "ref_id", "id", "left_semi", hot).select(*edges.columns)


def dangling_references(papers: DataFrame, table: DataFrame, id_col: str = "id", refs_col: str = "refs") -> DataFrame:
    """``(ref_id, id)`` of listed references that are no paper of ``table``, each once; those of a paper may become available
    when others arrive."""
    known = table.select(F.col(id_col).alias("ref_id"))
    edges = explode_references(papers, id_col, refs_col).where(F.col("ref_id").isNotNull())
    return edges.join(known, "ref_id", "left_anti").select("ref_id", "id").distinct()


def reference_dates(
    edges: DataFrame, papers: DataFrame, id_col: str = "id", date_col: str = "publication_date_int",
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """Available edges with the date of the reference; ids are unique, so one join does both."""
    dates = papers.select(F.col(id_col).alias("ref_id"), F.col(date_col).alias("ref_date"))
    return lookup_join(edges, dates, "ref_id", "id", "inner", hot).select(*edges.columns, "ref_date")


def rank_references(dated: DataFrame, limit: int, first: Sequence[Column] = ()) -> DataFrame:
    """The ``limit`` oldest references of each paper with their 0-based ``ref_rank``.

    Null dates come last and ties go to the lower ``ref_id``; ``first`` may put an order before the date.
    The limit is part of the window, so each map task cuts its part of a paper before the shuffle.
    """
    w = Window.partitionBy("id").orderBy(*first, F.col("ref_date").asc_nulls_last(), F.col("ref_id"))
    top = dated.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return top.withColumn("ref_rank", F.col("_n") - 1).drop("_n")


def reference_features(
    ranked: DataFrame, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding",
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """Ranked edges with the vector of the reference."""
    lookup = vectors.select(F.col(id_col).alias("ref_id"), F.col(vector_col).alias("embedding"))
    return lookup_join(ranked, lookup, "ref_id", "id", "inner", hot).select(*ranked.columns, "embedding")
