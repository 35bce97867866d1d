"""Dates as epoch nanoseconds, years, week-based durations and the sizes derived from them.

All date arithmetic runs on ``timestamp_ntz`` or plain integers, so no result depends on the
session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# A "year" of a fold is 52 weeks, and a float32 example is charged 32 times its size.
WEEKS_PER_YEAR = 52
FLOAT_BYTES = 4
EXAMPLE_BYTE_FACTOR = 32

DAY_NS = 86_400 * 1_000_000_000
FOLD_YEAR_NS = WEEKS_PER_YEAR * 7 * DAY_NS


def _epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def year_start_ns(year: int) -> int:
    """Epoch nanoseconds of 1 January of ``year``."""
    return (dt.date(year, 1, 1) - dt.date(1970, 1, 1)).days * DAY_NS


def to_epoch_us(ts: Column) -> Column:
    """``timestamp_ntz`` to epoch microseconds. Built from its parts, because a difference of timestamps goes through the
    session zone and moves values inside a daylight-saving gap."""
    local = ts.cast("timestamp_ntz")
    days = F.unix_date(local.cast("date")).cast("bigint")
    minutes = (days * F.lit(24) + F.hour(local)) * F.lit(60) + F.minute(local)
    return minutes * F.lit(60_000_000) + (F.date_part(F.lit("SECOND"), local) * F.lit(1_000_000)).cast("bigint")


def to_epoch_ns(ts: Column) -> Column:
    """``timestamp_ntz`` to epoch nanoseconds."""
    return to_epoch_us(ts) * F.lit(1000)


def from_epoch_ns(ns: Column) -> Column:
    """Epoch nanoseconds to ``timestamp_ntz``, rounding towards the past below a microsecond."""
    micros = F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def year_of_ns(ns: Column) -> Column:
    return F.year(from_epoch_ns(ns))


def year_to_ns(year: Column) -> Column:
    """Epoch nanoseconds of 1 January of a year column."""
    one, zero = F.lit(1), F.lit(0)
    return to_epoch_ns(F.make_timestamp_ntz(year, one, one, zero, zero, F.lit(0).cast("decimal(16,6)")))


def ceil_div(n: int, size: int) -> int:
    return -(-n // size)


def ceil_div_col(n: Column, size: int) -> Column:
    return F.call_function("div", n + F.lit(size - 1), F.lit(size))


def example_bytes(timepoints: int, n_features: int) -> int:
    """Bytes one example is planned with when shards are sized."""
    return (timepoints + 1) * n_features * FLOAT_BYTES * EXAMPLE_BYTE_FACTOR


def rows_per_shard(budget_bytes: int, timepoints: int, n_features: int) -> int:
    """Rows of one shard under a byte budget; an error when not even one row fits."""
    rows = budget_bytes // example_bytes(timepoints, n_features)
    if rows < 1:
        raise MemoryError("the byte budget holds less than one example")
    return rows


def shard_name(t_min: Column, t_max: Column, shard: Column) -> Column:
    """``{t_min}_{t_max}_shard_{n}``, the name shards carry outside Spark."""
    return F.concat_ws("_", t_min.cast("string"), t_max.cast("string"), F.lit("shard"), shard.cast("string"))


def interval_from_name(name: Column) -> tuple[Column, Column]:
    """(t_min, t_max) from a shard path or name, for files laid out by other tools."""
    stem = F.regexp_extract(name, r"([^/]+)$", 1)
    parts = F.split(stem, "_")
    return F.try_element_at(parts, F.lit(1)).cast("bigint"), F.try_element_at(parts, F.lit(2)).cast("bigint")
