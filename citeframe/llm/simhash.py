"""SimHash near-duplicates found through segment bit counts.

A fingerprint of 64 bits is mapped to the bit counts of its eight segments. The Manhattan distance of two such points
never exceeds the number of differing bits, so a range join under Manhattan distance finds every pair within a radius;
the bits are compared afterwards.

The join runs over a grid. Three coordinates, sums of counts, make its cells; a pair of cells that can hold neighbours is
a join unit, and a fingerprint goes only to units it lies near. Cells above ``BLOCK`` fingerprints are dealt out over
blocks, and every pair of blocks is a unit of its own, so a task holds two blocks at most. Within a unit the range join
goes on over all eight counts: sorted cells are probed at every displacement within the radius, or compared directly where
that is cheaper. A unit returns a forest that spans its links, never all pairs.

Equal fingerprints are one point from the start. An empty or null text has fingerprint zero. Null ids take no part in the
least id of a component; a component without any id has none. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe.llm.arrow_runs import runs
from citeframe.llm.components import connected_components
from citeframe.sources import scratch

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Most fingerprints of one side of a join unit.
BLOCK = 100_000
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20

# Fingerprints


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space into pieces of about PIECE bytes."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end]
        start = end


def shingle_hashes(text: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, piece by piece. Words end at ASCII white space."""
    words: list[bytes] = []
    many = False
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(text.lower()):
        words += piece.split()
        n = len(words) - width + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(words[i : n + i] for i in range(width)), strict=True))
            yield np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
            words, many = words[n:], True
    if words and not many:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bits set in over half of the shingle hashes."""
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width):
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return sum(1 << i for i in range(64) if 2 * int(counts[i]) > total)


def fingerprint_column(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint's bits as a signed bigint."""

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        known: dict[str | None, int] = {}
        for t in texts:
            if t not in known:
                value = fingerprint(t, width)
                known[t] = value - (1 << 64) if value >> 63 else value
        return pd.Series([known[t] for t in texts], dtype="int64")

    return prints(text)


# The grid

#: Segments of eight bits summed up for each grid coordinate, and the largest value of each.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
_SIDE = 2
_CELLS = tuple(8 * len(g) // _SIDE + 1 for g in _GROUPS)
_N_CELLS = int(np.prod(_CELLS))


def segment_counts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view(np.uint8).reshape(-1, 8)).astype(np.int64)


def _coordinates(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts[:, list(g)].sum(axis=1) for g in _GROUPS], axis=1)


def _cell_id(cells: np.ndarray) -> np.ndarray:
    return (cells[:, 0] * _CELLS[1] + cells[:, 1]) * _CELLS[2] + cells[:, 2]


def _cell_column(fingerprint: Column) -> Column:
    """The same cell number as a Spark expression."""
    masks = [sum(0xFF << (8 * s) for s in g) for g in _GROUPS]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    x, y, z = [F.floor(F.bit_count(fingerprint.bitwiseAND(F.lit(m))) / _SIDE) for m in masks]
    return ((x * _CELLS[1] + y) * _CELLS[2] + z).cast("int")


def _mixed(prints: np.ndarray) -> np.ndarray:
    x = prints * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def to_units(prints: np.ndarray, blocks: dict[int, int], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join units a fingerprint takes part in: unit number, side (0 or 1) and fingerprint.

    blocks: parts of each cell that has more than one."""
    at = _coordinates(segment_counts(prints))
    home, inside = at // _SIDE, at % _SIDE
    home_id = _cell_id(home)
    parts = np.ones(_N_CELLS, np.int64)
    for cell, n in blocks.items():
        parts[cell] = n
    part = (_mixed(prints) % parts[home_id].astype(np.uint64)).astype(np.int64)
    reach = radius // _SIDE + 1
    units, sides, rows = [], [], []
    for step in itertools.product(range(-reach, reach + 1), repeat=3):
        cost = np.zeros(len(prints), np.int64)
        near = np.ones(len(prints), bool)
        for axis, k in enumerate(step):
            if k > 0:
                cost += k * _SIDE - inside[:, axis]
            elif k < 0:
                cost += inside[:, axis] + 1 + (-k - 1) * _SIDE
            near &= (home[:, axis] + k >= 0) & (home[:, axis] + k < _CELLS[axis])
        pick = np.flatnonzero(near & (cost <= radius))
        there = _cell_id(home[pick] + np.array(step))
        here, own = home_id[pick], part[pick]
        copies = parts[there]  # meets every part of the other cell
        pick, here, there, own = (np.repeat(x, copies) for x in (pick, here, there, own))
        other = np.arange(len(pick)) - np.repeat(np.cumsum(copies) - copies, copies)
        same = here == there
        first = np.where(same, own <= other, here < there)
        low = np.where(same, here, np.minimum(here, there))
        high = np.maximum(here, there)
        i, j = np.where(first, own, other), np.where(first, other, own)
        units.append(((low * _N_CELLS + high) << 32) | (i << 16) | j)
        sides.append(np.where(same & (own == other), 0, np.where(first, 0, 1)))
        rows.append(prints[pick])
    return np.concatenate(units), np.concatenate(sides), np.concatenate(rows)


# Within a unit


def displacements(radius: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Displacements of the eight counts within the radius, as differences of packed counts, by their effect on the
    grid coordinates."""
    found: dict[tuple[int, int, int], list[int]] = {}

    def extend(prefix: tuple[int, ...], left: int) -> None:
        if len(prefix) == 8:
            moved = tuple(sum(prefix[s] for s in g) for g in _GROUPS)
            found.setdefault(moved, []).append(sum(d << (4 * s) for s, d in enumerate(prefix)))
            return
        for d in range(-left, left + 1):
            extend((*prefix, d), left - abs(d))

    extend((), radius)
    return {k: np.array(v, np.int64) for k, v in found.items()}


class Forest:
    """Labels of points that links join."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.label[left], self.label[right]
        differ = a != b
        if not differ.any():
            return
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for x, y in np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0).tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        new = np.arange(len(self.label))
        for x in parent:
            new[x] = root(x)
        self.label = new[self.label]


def _link_directly(forest: Forest, prints: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> None:
    """Compares all of two sets, leaving out what is linked already, so a crowd of neighbours costs little."""
    size = max(1, min(1024, 2_000_000 // max(1, len(right))))
    while len(left):
        labels = forest.label[left]
        crowd = Counter(labels[: 4 * size].tolist()).most_common(1)[0][0]
        order = np.argsort(labels != crowd, kind="stable")
        now, left = left[order[:size]], left[order[size:]]
        one = forest.label[now]
        other = right[forest.label[right] != one[0]] if (one == one[0]).all() else right
        i, j = np.nonzero(np.bitwise_count(prints[now][:, None] ^ prints[other][None, :]) <= bits)
        forest.link(now[i], other[j])


def _link_by_probes(
    forest: Forest, prints: np.ndarray, packed: np.ndarray, left: np.ndarray, right: np.ndarray, steps: np.ndarray, bits: int
) -> None:
    """Looks up the cells of ``left`` that each point of ``right`` reaches, then compares the bits."""
    left = left[np.argsort(packed[left], kind="stable")]
    keys = packed[left]
    for step in steps.tolist():
        start = np.searchsorted(keys, packed[right] - step, "left")
        end = np.searchsorted(keys, packed[right] - step, "right")
        hit = np.flatnonzero(end > start)
        for part in np.array_split(hit, int((end[hit] - start[hit]).sum()) // 2_000_000 + 1):
            n = end[part] - start[part]
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[part], n)
            a, b = left[i], np.repeat(right[part], n)
            near = np.bitwise_count(prints[a] ^ prints[b]) <= bits
            forest.link(a[near], b[near])


def link_unit(prints: np.ndarray, side: np.ndarray, own: bool, bits: int, steps: dict) -> np.ndarray:
    """Label of each fingerprint of a unit; ``own``: both sides are one block."""
    forest = Forest(len(prints))
    counts = segment_counts(prints)
    at = _coordinates(counts)
    packed = ((counts + 3) << (4 * np.arange(8))).sum(axis=1)
    spot = (at[:, 0] << 16) | (at[:, 1] << 8) | at[:, 2]
    order = np.argsort(spot, kind="stable")
    cuts = np.flatnonzero(np.diff(spot[order])) + 1
    groups = [g for g in np.split(order, cuts) if len(g)]
    spots = [(tuple(at[g[0]].tolist()), g[side[g] == 0], g[side[g] == 1]) for g in groups]
    for n, (p, p0, p1) in enumerate(spots):
        for q, q0, q1 in spots[n if own else 0 :]:
            left, right = (p0, q0) if own else (p0, q1)
            moved = tuple(b - a for a, b in zip(p, q, strict=True))
            if not len(left) or not len(right) or sum(map(abs, moved)) > bits:
                continue
            reach = steps[moved]
            if len(left) * len(right) < 150 * len(reach) * (len(right) + 100):
                _link_directly(forest, prints, left, right, bits)
            else:
                _link_by_probes(forest, prints, packed, left, right, reach, bits)
    return forest.label


def links(spark: SparkSession, prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """A forest (a, b) that connects exactly the fingerprints which chains of links of at most ``bits`` bits connect.

    prints: one column ``fingerprint`` without repeats. Beyond three bits the packed counts would run into each other."""
    if not 0 <= bits <= 3:
        raise ValueError("at most 3 bits")
    # One row per grid cell, 1,521 at most.
    sizes = prints.groupBy(_cell_column(F.col("fingerprint")).alias("cell")).count().filter(F.col("count") > BLOCK).collect()
    blocks = {r["cell"]: -(-r["count"] // BLOCK) for r in sizes}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start in range(0, len(all_prints), 8192):
                unit, side, rows = to_units(all_prints[start : start + 8192], blocks, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit), pa.array(side.astype(np.int8)), pa.array(rows.view(np.int64))], ["unit", "side", "fingerprint"]
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = displacements(bits)
        for unit, rows in runs(batches, "unit"):
            if rows.num_rows < 2:
                continue
            own = (unit >> 32) // _N_CELLS == (unit >> 32) % _N_CELLS and (unit >> 16) & 0xFFFF == unit & 0xFFFF
            found = rows["fingerprint"].to_numpy().view(np.uint64)
            label = link_unit(found, rows["side"].to_numpy(), bool(own), bits, steps)
            tied = np.flatnonzero(label != np.arange(len(label)))
            if len(tied):
                pairs = [pa.array(found[x].view(np.int64)) for x in (tied, label[tied])]
                yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    units = prints.select("fingerprint").mapInArrow(spread, "unit bigint, side tinyint, fingerprint bigint")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(join, "a bigint, b bigint")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text_md5, fingerprint, cluster, component_id) of every row: ``cluster`` is the least fingerprint that chains of
    links reach, ``component_id`` the least id."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"), fingerprint_column(text, shingle).alias("fingerprint"))
    path = scratch.new_path(spark, "fingerprints")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    points = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    roots = connected_components(spark, links(spark, points.select("fingerprint"), bits)).withColumnRenamed("node", "fingerprint")
    tied = roots.join(points, "fingerprint")
    least = tied.groupBy("root").agg(F.min("least").alias("component_least"))
    named = points.join(tied.select("fingerprint", "root").join(least, "root"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("cluster"), F.coalesce("component_least", "least").alias("component_id")
    )
    path = scratch.new_path(spark, "clusters")  # read again, so that the join below can split a fingerprint many rows share
    named.write.parquet(path)
    return rows.join(spark.read.parquet(path), "fingerprint").select("id", "text_md5", "fingerprint", "cluster", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one of each cluster: the least id stays, then the least text digest; equal rows
    count once. Rows without an id come after all others."""
    found = near_duplicates(spark, docs, **options)
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "text_md5")
    first = found.groupBy("cluster").agg(F.min(rank).alias("r")).select(F.col("r.id").alias("k_id"), F.col("r.text_md5").alias("k_md5"))
    md5 = F.md5(F.coalesce("text", F.lit("")))
    held = docs.withColumn("k_text_md5", md5).join(
        first, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_text_md5") == F.col("k_md5")), "inner"
    )
    nth = F.row_number().over(Window.partitionBy("doc_id", "k_text_md5").orderBy(F.lit(0)))
    return held.withColumn("k_nth", nth).filter("k_nth = 1").select(*docs.columns)
