"""A filter of fixed size that keeps a scan to the keys another table may ask for, ahead of any shuffle.

The keys are hashed into a blocked Bloom filter: one block of ``BLOCK_BITS`` bits per hash bucket and ``PROBES`` bits a key within it.
Blocks are bitmap aggregates, combined map-side; at most ``blocks`` rows of 4 KB are broadcast, however many keys there are. A
key that was put in is always found. With 16 bits a key about one in 200 others passes, with 4 bits one in 7, and a
filter that is too small only passes more, so callers still join by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768  # the fixed size of a bitmap aggregate
WORD_BITS = 64
PROBES = 3
#: Blocks of 4 KB: a broadcast of at most 16 MB.
BLOCKS = 4096

_PROBE_BITS = 15  # 2 ** 15 = BLOCK_BITS


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _probes(key: Column) -> list[Column]:
    """Bit positions within the block, from another hash of the key."""
    other = F.xxhash64(key, F.lit("probe"))
    return [F.shiftright(other, _PROBE_BITS * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def _words(bitmap: Column) -> Column:
    """A bitmap as 64-bit words of eight bytes, most significant first; byte ``p / 8`` holds bit ``p % 8``."""
    n = BLOCK_BITS // WORD_BITS

    def word(i: Column) -> Column:
        return F.conv(F.hex(F.substr(bitmap, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word)


def key_blocks(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter as rows ``(block, words)`` of the blocks that hold a key; null keys are left out."""
    placed = keys.where(F.col(key).isNotNull()).select(
        _block(F.col(key), blocks).alias("block"), F.explode(F.array(*_probes(F.col(key)))).alias("bit")
    )
    bitmaps = placed.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return bitmaps.select("block", _words(F.col("bitmap")).alias("words"))


def may_hold(rows: DataFrame, key: str, filter_blocks: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows whose key may be among those of the filter: all that are, and a few others."""
    found = filter_blocks.select(F.col("block").alias("_block"), F.col("words").alias("_words"))
    joined = rows.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(found), "_block")
    passed = None
    for bit in _probes(F.col(key)):
        word = F.element_at("_words", (F.shiftright(bit, 6) + 1).cast("int"))
        # Bit p of a byte lies in byte 7 - (p / 8) % 8 from the low end of its word.
        shift = (F.lit(7) - F.shiftright(bit, 3).bitwiseAND(F.lit(7))) * 8 + bit.bitwiseAND(F.lit(7))
        held = F.call_function("shiftright", word, shift.cast("int")).bitwiseAND(F.lit(1)) == 1
        passed = held if passed is None else passed & held
    return joined.where(passed).select(*rows.columns)
