"""Vector codes: product quantisation whose codebooks are learnt by Lloyd rounds over cover trees.

Vectors are made integers (``floor(SCALE * x)``) and cut into equal consecutive parts; every part position has a codebook of its
own. Each block of a partition keeps one cover tree a part position: a node covers a run of points within its radius, its
children are centres that lie more than half that radius apart, and the points stand in tree order, so the sum over a subtree is
a difference of two cumulative sums. A round takes the nodes level by level: where the nearest entry is closer than the
second nearest by more than twice the radius, the triangle inequality gives the whole subtree to it; other nodes hand over
to their children, and the points of ambiguous leaves are compared one by one. Trees are built once, written, and read by every round.

All sums and distances are integers, so results do not depend on partitions; the float margin of a pruned node is widened
by ``MARGIN``. The driver sees one codebook (entries x dimension) and its sums.

Vectors that are null, or hold null or non-finite components, take no part, nor do vectors of another length than that of
the first one by id, or components of ``LIMIT`` and more after scaling (an error, as distances would leave 64 bits). Repeated
vectors and ids stay, equal ids are ordered by vector, null ids come last. With fewer vectors than entries the codebooks are
shorter, an empty table gives no rows. Equal entries count as the lowest of them. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.sources import scratch

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors that share a tree, and points below which a node is not split.
BLOCK = 4096
LEAF = 24
LIMIT = 1 << 26
MARGIN = 1e-9


def whole_vector(vector: Column) -> Column:
    """True where a vector has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two integer tables."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


# Trees


@dataclass
class Tree:
    """Distinct points in tree order with their weights; nodes as runs ``lo:hi`` of them, parents before children, the
    children of a node at ``first:last`` (none: a leaf)."""

    points: np.ndarray
    weights: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _children(points: np.ndarray, rows: np.ndarray, radius: float) -> Iterator[np.ndarray]:
    """Rows dealt to centres: the first row left is a centre and takes what lies within half the radius."""
    left = rows
    while len(left):
        far = ((points[left] - points[left[0]]) ** 2).sum(axis=1)
        near = far * 4.0 <= radius * radius
        near[0] = True
        yield left[near]
        left = left[~near]


def cover_tree(raw: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over the rows of an integer table, and the place of each row's point in it."""
    points, place, weights = np.unique(raw, axis=0, return_inverse=True, return_counts=True)
    place = place.reshape(-1)
    runs, lo, center, radius, first, last = [np.arange(len(points))], [0], [], [], [], []
    order = np.empty(len(points), np.int64)
    i = 0
    while i < len(runs):
        rows = runs[i]
        far = ((points[rows] - points[rows[0]]) ** 2).sum(axis=1)
        r = float(np.sqrt(far.max()))
        center.append(rows[0])
        radius.append(r)
        first.append(len(runs))
        if len(rows) > LEAF and r > 0:
            start = lo[i]
            for child in _children(points, rows, r):
                runs.append(child)
                lo.append(start)
                start += len(child)
        else:
            order[lo[i] : lo[i] + len(rows)] = rows
        last.append(len(runs))
        i += 1
    at = np.empty(len(points), np.int64)
    at[order] = np.arange(len(points))
    sizes = np.array([len(x) for x in runs])
    nodes = np.array(lo)
    tree = Tree(
        points[order], weights[order], at[np.array(center)], np.array(radius), nodes, nodes + sizes, np.array(first), np.array(last)
    )
    return tree, at[place]


def assign(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of every point, the lowest of equal ones."""
    out = np.empty(len(tree.points), np.int64)
    distinct, lowest = np.unique(entries, axis=0, return_index=True)
    in_order = np.argsort(lowest)
    distinct, lowest = distinct[in_order], lowest[in_order]
    if len(distinct) == 1:
        out[:] = lowest[0]
        return out
    level = np.array([0])
    while len(level):
        far = np.sqrt(_squared(tree.points[tree.center[level]], distinct).astype(np.float64))
        nearest = far.argmin(axis=1)
        two = np.partition(far, 1, axis=1)
        clear = two[:, 1] - two[:, 0] > 2 * tree.radius[level] * (1 + MARGIN) + MARGIN * two[:, 1]
        for node, entry in zip(level[clear].tolist(), lowest[nearest[clear]].tolist(), strict=True):
            out[tree.lo[node] : tree.hi[node]] = entry
        level = level[~clear]
        inner = tree.last[level] > tree.first[level]
        leaves = level[~inner]
        if len(leaves):
            rows = np.concatenate([np.arange(a, b) for a, b in zip(tree.lo[leaves], tree.hi[leaves], strict=True)])
            out[rows] = lowest[_squared(tree.points[rows], distinct).argmin(axis=1)]
        level = level[inner]
        if len(level):
            level = np.concatenate([np.arange(a, b) for a, b in zip(tree.first[level], tree.last[level], strict=True)])
    return out


def entry_sums(tree: Tree, nearest: np.ndarray, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted sums of the points of each entry: differences of cumulative sums over the runs of one entry."""
    counts, sums = np.zeros(n_entries, np.int64), np.zeros((n_entries, tree.points.shape[1]), np.int64)
    if not len(nearest):
        return counts, sums
    until = np.concatenate([[0], np.cumsum(tree.weights)])
    totals = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points * tree.weights[:, None], axis=0)])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(nearest)) + 1, [len(nearest)]])
    entry = nearest[cuts[:-1]]
    np.add.at(counts, entry, until[cuts[1:]] - until[cuts[:-1]])
    np.add.at(sums, entry, totals[cuts[1:]] - totals[cuts[:-1]])
    return counts, sums


# Blocks: one row holds the vectors' ids and the trees of all part positions.

_LISTS = ("points", "weights", "center", "radius", "lo", "hi", "first", "last", "member")
_NESTED = ", ".join(f"{c} array<array<{'double' if c == 'radius' else 'int'}>>" for c in _LISTS)
_NESTED_TYPES = {c: pa.list_(pa.list_(pa.float64() if c == "radius" else pa.int32())) for c in _LISTS}


def _block(rows: pa.Array, vectors: np.ndarray, parts: int) -> pa.RecordBatch:
    lists: dict[str, list] = {c: [] for c in _LISTS}
    for piece in np.split(vectors, parts, axis=1):
        tree, member = cover_tree(piece)
        for c in _LISTS[:-1]:
            lists[c].append(getattr(tree, c).reshape(-1))
        lists["member"].append(member)
    columns = [pa.array([lists[c]], _NESTED_TYPES[c]) for c in _LISTS]
    whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
    return pa.RecordBatch.from_arrays([whole, *columns], ["rows", *_LISTS])


def _trees(batch: pa.RecordBatch, parts: int) -> Iterator[list[Tree]]:
    for i in range(batch.num_rows):
        read = {c: [np.asarray(batch.column(c)[i].values[p].values) for p in range(parts)] for c in _LISTS[:-1]}
        out = []
        for p in range(parts):
            lists = {c: read[c][p] for c in _LISTS[:-1]}
            lists["points"] = lists["points"].astype(np.int64).reshape(len(lists["weights"]), -1)
            lists["weights"] = lists["weights"].astype(np.int64)
            out.append(Tree(**lists))
        yield out


def _scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _blocks(parts: int, dimension: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                vectors = piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                if len(vectors) and np.abs(vectors).max() >= LIMIT:
                    raise ValueError(f"a scaled component is {LIMIT} or more")
                yield _block(piece.column("row"), vectors, parts)

    return build


def _summed(books: np.ndarray):
    parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, n_entries), np.int64), np.zeros((parts, n_entries, width), np.int64)
        for batch in batches:
            for trees in _trees(batch, parts):
                for p, tree in enumerate(trees):
                    n, s = entry_sums(tree, assign(tree, books[p]), n_entries)
                    counts[p] += n
                    sums[p] += s
        p, e, x = (g.reshape(-1) for g in np.meshgrid(*map(np.arange, books.shape), indexing="ij"))
        rows = [p, e, x, counts[p, e], sums.reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in rows], ["part", "entry", "place", "n", "total"])

    return run


def _coded(books: np.ndarray):
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(_trees(batch, parts)):
                rows = batch.column("rows")[i].values
                codes, errors = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
                for p, tree in enumerate(trees):
                    nearest = assign(tree, books[p])
                    far = ((tree.points - books[p][nearest]) ** 2).sum(axis=1)
                    member = np.asarray(batch.column("member")[i].values[p].values)
                    codes[:, p] = nearest[member]
                    errors += far[member]
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([rows, packed, pa.array(errors)], ["row", "code", "error"])

    return run


@dataclass
class Codes:
    """``coded``: vec_id, carried columns, code (a byte for each part position), error; ``books``: entries by part position."""

    coded: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    carry: tuple[str, ...] = (),
) -> Codes:
    """Codes of ``vectors`` (vec_id, embedding). Learning runs ``rounds`` jobs when called."""
    if not 0 < entries <= 256:
        raise ValueError("an entry must fit a byte")
    row, scaled = F.struct("vec_id", *carry).alias("row"), _scaled(F.col("embedding"), scale).alias("v")
    kept = vectors.filter(whole_vector(F.col("embedding"))).select(row, scaled)
    order = [F.col("row.vec_id").asc_nulls_last(), F.col("v")]
    head = kept.orderBy(*order).limit(1).collect()
    dimension = len(head[0]["v"]) if head else 0
    if dimension % parts:
        raise ValueError(f"{dimension} components cannot be cut into {parts} equal parts")
    kept = kept.filter(F.size("v") == dimension)
    if not dimension:
        plain = kept.select("row.*", F.unhex(F.lit("00" * parts)).alias("code"), F.lit(0).cast("bigint").alias("error"))
        return Codes(plain, np.zeros((parts, 0, 0), np.int64))
    first = kept.orderBy(*order).limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    kind = dict(kept.dtypes)["row"]
    schema = f"rows array<{kind}>, {_NESTED}"
    path = scratch.new_path(spark, "cover-trees")
    kept.mapInArrow(_blocks(parts, dimension), schema).write.parquet(path)
    blocks = spark.read.schema(schema).parquet(path)
    for _ in range(rounds):
        partial = blocks.select(*_LISTS[:-1]).mapInArrow(_summed(books), "part bigint, entry bigint, place bigint, n bigint, total bigint")
        books = books.copy()
        for r in partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            if r["n"]:
                books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    coded = blocks.mapInArrow(_coded(books), f"row {kind}, code binary, error bigint")
    return Codes(coded.select("row.*", "code", "error"), books)
