"""Approximate nearest neighbours by stable projections in a kd-tree.

Vectors are projected on ``M`` directions with normal components, so a squared projected distance is the true one times a
chi-square variable with ``M`` degrees of freedom. The projections are cut into the cells of a kd-tree, whose splits come
from a bounded sample; every vector is indexed. Cells above ``BLOCK`` vectors are dealt out over blocks.

A query first looks into its own cell, which bounds the distance of its k-th neighbour. It then goes to every cell whose box
lies near enough. Within a block, points are verified in the order of projected distance, by the true distance, until the
stopping test holds: a point as near as the k-th best so far would have been closer in projection with probability
``CONFIDENCE``. A block is held in memory while any number of queries streams past it.

Of equal vectors only the ``k + 1`` least ids can be among anyone's neighbours and are indexed, and equal queries are searched
once. Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor
do rows without an id. Equal rows count once; an id with several vectors stands for several rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe.sources import scratch

M = 8
CONFIDENCE = 0.95
SEED = 7
#: Vectors the tree's splits are taken from.
SAMPLE = 16_384
#: Vectors aimed at in a cell, most cells, most vectors of a block.
CELL = 2_000
MAX_CELLS = 4_096
BLOCK = 8_000

# Chi-square


def chi_square_cdf(x: float, degrees: int) -> float:
    """Series of the regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = degrees / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, degrees) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


# The tree


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, M))


@dataclass(frozen=True)
class Tree:
    """Inner nodes in heap order: axis and value of each split; leaves are cells."""

    axis: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.axis) + 1).bit_length() - 1

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.value[node])
        return node - len(self.axis)


def build_tree(sample: np.ndarray, n_cells: int) -> Tree:
    """Median splits along the axis of the widest spread."""
    depth = max(0, (n_cells - 1).bit_length())
    inner = (1 << depth) - 1
    axis, value = np.zeros(inner, np.int64), np.zeros(inner)
    parts = {0: sample}
    for node in range(inner):
        part = parts.pop(node)
        if len(part):
            axis[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            value[node] = np.median(part[:, axis[node]])
        right = part[:, axis[node]] > value[node] if len(part) else np.zeros(0, bool)
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return Tree(axis, value)


# Search within a block


def nearest_in_block(
    query: np.ndarray, projected: np.ndarray, ids: np.ndarray, points: np.ndarray, cast: np.ndarray, k: int, bound: float, factor: float
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest points not beyond ``bound``, verified in the order of projected distance."""
    shadow = ((cast - projected) ** 2).sum(axis=1)
    order = np.argsort(shadow, kind="stable")
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    at, step, limit = 0, 128, bound
    while at < len(order):
        if shadow[order[at]] > factor * limit * limit:
            break  # the stopping test
        now = order[at : at + step]
        d = np.sqrt(((points[now] - query) ** 2).sum(axis=1))
        near = d <= limit
        d, i = np.concatenate([best_d, d[near]]), np.concatenate([best_i, ids[now][near]])
        pick = np.lexsort((i, d))[:k]
        best_d, best_i = d[pick], i[pick]
        if len(best_d) == k:
            limit = min(limit, float(best_d[-1]))
        at, step = at + step, 2 * step
    return best_i, best_d


_UNIT = "unit bigint, side tinyint, vec_id bigint, qkey string, v array<double>, p array<double>, bound double"
_FOUND = "qkey string, vec_id bigint, score double"


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _searcher(k: int, dim: int):
    factor = chi_square_quantile(CONFIDENCE, M)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, points, cast = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "side"))
            cut = [0, *(np.flatnonzero((np.diff(unit) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(unit)]
            keys, n_ids, found_i, found_d = [], [], [], []
            for start, end in zip(cut, cut[1:], strict=False):
                part = batch.slice(start, end - start)
                v, p = _rows_of(part.column("v"), dim), _rows_of(part.column("p"), M)
                if unit[start] != now:
                    now, ids, points, cast = unit[start], [], [], []
                if side[start] == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    points.append(v)
                    cast.append(p)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, points, cast = [np.concatenate(ids)], [np.concatenate(points)], [np.concatenate(cast)]
                bounds = part.column("bound").to_numpy()
                for q, key in enumerate(part.column("qkey").to_pylist()):
                    i, d = nearest_in_block(v[q], p[q], ids[0], points[0], cast[0], k, bounds[q], factor)
                    keys.append(key)
                    n_ids.append(len(i))
                    found_i.append(i)
                    found_d.append(d)
            if keys:
                all_keys = pa.array(keys).take(pa.array(np.repeat(np.arange(len(keys)), n_ids)))
                yield pa.RecordBatch.from_arrays(
                    [all_keys, pa.array(np.concatenate(found_i)), pa.array(np.concatenate(found_d))], ["qkey", "vec_id", "score"]
                )

    return search


# Spark


def _usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).filter(_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy("score", "vec_id")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch.new_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row for which ``is_query`` holds."""
    rows = usable_vectors(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    dim = len(sample.iloc[0]) if len(sample) else 1
    project = directions(dim)
    tree = build_tree(
        np.array(sample.tolist(), dtype=np.float64).reshape(-1, dim) @ project, min(MAX_CELLS, max(1, rows.count() // CELL))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _rows_of(batch.column("v"), dim) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * M), pa.array(p.ravel()))
            names = [*batch.schema.names, "p", "cell"]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(tree.cells(p).astype(np.int32))], names)

    copies = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.dense_rank().over(copies)).filter(F.col("r") <= k + 1).drop("r").dropDuplicates(["v", "vec_id"])
    points = _kept(spark, few.mapInArrow(place, "vec_id bigint, v array<double>, p array<double>, cell int"), "points")
    # One row per cell, MAX_CELLS at most.
    box = [f(F.col("p")[i]) for i in range(M) for f in (F.min, F.max)]
    cells = sorted(points.groupBy("cell").agg(F.count("*").alias("n"), F.array(*box).alias("box")).collect(), key=lambda r: r["cell"])
    blocks = np.ones(len(tree.axis) + 1, np.int64)
    for r in cells:
        blocks[r["cell"]] = -(-r["n"] // BLOCK)
    there = np.array([r["cell"] for r in cells], np.int64)
    box = np.array([r["box"] for r in cells], np.float64).reshape(-1, M, 2)
    factor = chi_square_quantile(CONFIDENCE, M)

    asked = _kept(
        spark, rows.filter(is_query).select("vec_id", "v", F.md5(F.col("v").cast("string")).alias("qkey")).dropDuplicates(["vec_id", "qkey"]), "queries"
    )
    distinct = asked.dropDuplicates(["qkey"]).select("qkey", "v")
    placed = distinct.mapInArrow(place, "qkey string, v array<double>, p array<double>, cell int")

    def route(near: bool):
        """Query rows for the blocks of their own cell, or of all others their ball may reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    own = part.column("cell").to_numpy()
                    if near:
                        row, cell = np.arange(len(own)), own
                        bound = np.full(len(own), np.inf)
                    else:
                        p = _rows_of(part.column("p"), M)
                        all_bounds = part.column("bound").to_numpy()
                        gap = np.maximum(0, np.maximum(box[None, :, :, 0] - p[:, None], p[:, None] - box[None, :, :, 1]))
                        reach = (gap**2).sum(axis=2) <= factor * (all_bounds**2)[:, None]
                        row, at = np.nonzero(reach & (there[None, :] != own[:, None]))
                        cell, bound = there[at], all_bounds[row]
                    n = blocks[cell]
                    row, cell, bound = np.repeat(row, n), np.repeat(cell, n), np.repeat(bound, n)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    for a in range(0, len(row), 8192):
                        z = slice(a, a + 8192)
                        take = pa.array(row[z])
                        size = len(row[z])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array((cell[z].astype(np.int64) << 32) | block[z]), pa.array(np.ones(size, np.int8)),
                                pa.nulls(size, pa.int64()), part.column("qkey").take(take), part.column("v").take(take),
                                part.column("p").take(take), pa.array(bound[z]),
                            ],
                            ["unit", "side", "vec_id", "qkey", "v", "p", "bound"],
                        )

        return run

    def of_cell(column: Column) -> Column:
        counts = [int(x) for x in blocks]
        if max(counts) == 1:
            return F.lit(0)
        return F.pmod(F.xxhash64(column), F.element_at(F.lit(counts), F.col("cell") + 1))

    unit = F.shiftleft(F.col("cell").cast("bigint"), 32).bitwiseOR(of_cell(F.col("vec_id")).cast("bigint"))
    held = points.select(
        unit.alias("unit"), F.lit(0).cast("tinyint").alias("side"), "vec_id", F.lit(None).cast("string").alias("qkey"), "v", "p",
        F.lit(None).cast("double").alias("bound"),
    )

    def searched(routed: DataFrame) -> DataFrame:
        met = held.union(routed).repartition("unit").sortWithinPartitions("unit", "side")
        return met.mapInArrow(_searcher(k + 1, dim), _FOUND)

    first = _kept(spark, _top(searched(placed.mapInArrow(route(True), _UNIT)), k + 1), "own-cell")
    reached = first.groupBy("qkey").agg(F.when(F.count("*") > k, F.max("score")).alias("bound"))
    bounded = placed.join(reached, "qkey", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    others = searched(bounded.mapInArrow(route(False), _UNIT))
    best = _kept(spark, _top(first.union(others), k + 1), "best")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "qkey").join(best, "qkey").filter(F.col("vec_id") != F.col("query_id"))
    nth = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
