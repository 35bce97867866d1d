"""Shards by fixed virtual slots and a versioned slot-to-shard map.

A record's key picks one of thousands of slots and never another one. Which shard a slot belongs to is a table of one row
per slot; rebalancing edits that table, moving as few slots as it needs, and writes the result as the next version.

The only thing the driver sees is one row per slot. Null keys fall into one slot, a null text counts zero bytes, equal
keys share a slot, and empty tables give an empty placement over a complete map.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, slot_bytes bigint, slot_rows bigint"
#: Largest difference between two shards, as a part of a shard's fair share, that rebalancing leaves alone.
TOLERANCE = 0.0005


def with_slot(records: DataFrame, keys: list[str], n_slots: int = N_SLOTS, name: str = "virtual_slot") -> DataFrame:
    return records.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int"))


def slot_loads(slotted: DataFrame, size: str, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """Bytes and rows of each slot, in slot order. At most ``n_slots`` rows reach the driver."""
    loads = [(0, 0)] * n_slots
    sums = slotted.groupBy("virtual_slot").agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    for row in sums.collect():
        loads[row["virtual_slot"]] = (int(row["b"] or 0), int(row["n"]))
    return loads


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    """The map before any size is known: slots dealt out in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalance(current: list[int], weights: list[int], n_shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited until shard weights are near equal: first the surplus of heavy shards (and of shards that no longer
    exist) goes to the lightest ones, largest slots first, then single slots move or swap while that evens out a pair."""
    shard_of, load = list(current), [0] * n_shards
    target = sum(weights) / n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    loose = []
    for slot in sorted(range(len(shard_of)), key=lambda s: (-weights[s], s)):
        shard = shard_of[slot]
        if shard >= n_shards or load[shard] + weights[slot] > target:
            loose.append(slot)
        else:
            load[shard] += weights[slot]
            held[shard].append(slot)
    for slot in loose:
        shard = min(range(n_shards), key=lambda s: (load[s], s))
        shard_of[slot] = shard
        load[shard] += weights[slot]
        held[shard].append(slot)
    while max(load) - min(load) > tolerance * target:
        if not _even_out(held, load, shard_of, weights):
            break
    return shard_of


def _even_out(held: list[list[int]], load: list[int], shard_of: list[int], weights: list[int]) -> bool:
    """One move or swap between the heaviest shard and a lighter one, the lightest first; false when none helps."""
    order = sorted(range(len(load)), key=lambda s: load[s])
    heavy = order[-1]
    for light in order[:-1]:
        gap = load[heavy] - load[light]
        there = sorted((weights[s], s) for s in held[light])
        best, pick = gap, None
        for slot in held[heavy]:
            k = bisect_left(there, (weights[slot] - gap // 2, -1))
            for back in [None, *[x for x in there[max(0, k - 1) : k + 1]]]:
                moved = weights[slot] - (back[0] if back else 0)
                if moved > 0 and abs(gap - 2 * moved) < best:
                    best, pick = abs(gap - 2 * moved), (slot, back[1] if back else None, moved)
        if pick:
            slot, back, moved = pick
            held[heavy].remove(slot)
            held[light].append(slot)
            shard_of[slot] = light
            if back is not None:
                held[light].remove(back)
                held[heavy].append(back)
                shard_of[back] = heavy
            load[heavy] -= moved
            load[light] += moved
            return True
    return False


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int], loads: list[tuple[int, int]]) -> None:
    """Adds one version to the stored map; earlier versions stay."""
    rows = [(version, slot, shard, *loads[slot]) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest unless told otherwise."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def store_balanced_map(
    spark: SparkSession, slotted: DataFrame, size: str, n_shards: int, path: str, n_slots: int = N_SLOTS
) -> None:
    """Version 1 deals slots out in turn; version 2 is its edit for the bytes found in the slots."""
    loads = slot_loads(slotted, size, n_slots)
    first = initial_map(n_slots, n_shards)
    write_map(spark, path, 1, first, loads)
    write_map(spark, path, 2, rebalance(first, [b for b, _ in loads], n_shards), loads)


def place(slotted: DataFrame, slot_map: DataFrame, order_by: list[str]) -> DataFrame:
    """Adds ``shard``, ``position`` (gapless from 0 within the shard) and ``map_version``.

    Rows are numbered within their slot and shifted by the rows of the shard's earlier slots, so no task sees a shard.
    The map has one row per slot and is broadcast."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("slot_rows").over(before), F.lit(0))
    starts = slot_map.select(F.col("version").alias("map_version"), F.col("slot").alias("virtual_slot"), "shard", start.alias("start"))
    numbered = slotted.withColumn("nth", F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order_by)) - 1)
    return (
        numbered.join(F.broadcast(starts), "virtual_slot")
        .withColumn("position", (F.col("start") + F.col("nth")).cast("bigint"))
        .drop("start", "nth")
    )
