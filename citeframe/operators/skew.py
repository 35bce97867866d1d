"""Lookups by a key that a large share of the rows may carry.

Adaptive execution splits such a join partition while it runs, so with it (the default) nothing else is
needed. For sessions without it, the hot keys are found first and their rows are dealt out over copies of
the one row they look up. The join result is the same in both cases.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key with more than this share of the rows is hot, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001

_COPY = "_copy"


def splits_skew(spark: SparkSession) -> bool:
    """Whether the session splits skewed join partitions by itself."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name) == "true" for name in names)


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> dict[int, int]:
    """Hot keys and the number of parts to cut each into, from one bounded sketch of the key column.

    The sketch may misjudge a key near the limit; that only moves work, never rows.
    """
    k = math.ceil(1 / share)
    top = F.call_function("approx_top_k", F.col(key), F.lit(k), F.lit(10 * k))
    found = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), top.alias("top")).first()
    limit = found["n"] * share
    return {r["item"]: math.ceil(r["count"] / limit) for r in found["top"] or [] if r["count"] > limit}


def _copies(key: Column, hot: Mapping[int, int]) -> Column:
    pairs = [F.lit(v) for pair in hot.items() for v in pair]
    return F.when(key.isin(list(hot)), F.create_map(*pairs)[key]).otherwise(F.lit(1))


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, spread_by: str, how: str = "inner", hot: Mapping[int, int] | None = None
) -> DataFrame:
    """Joins ``rows`` to the unique ``key`` of ``table``; ``hot=None`` looks for hot keys when the session needs it."""
    if hot is None:
        hot = {} if splits_skew(rows.sparkSession) else hot_keys(rows, key)
    if not hot:
        return rows.join(table, key, how)
    copies = _copies(F.col(key), hot)
    dealt = rows.withColumn(_COPY, F.pmod(F.xxhash64(spread_by), copies).cast("int"))
    copied = table.withColumn(_COPY, F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(copied, [key, _COPY], how).drop(_COPY)
