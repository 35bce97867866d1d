"""Scans over a papers dataset and the schema-checked writers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.functions.references import WORK_PREFIX, parse_reference_list
from citeframe.functions.timeline import DAY_NS
from citeframe.functions.vectors import feature_columns


def open_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A multi-file dataset in any Spark file format, read lazily."""
    return spark.read.format(fmt).load(path)


def scan_all(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def scan_range(df: DataFrame, cols: Sequence[str], low, high, range_col: str) -> DataFrame:
    """Rows with ``low <= range_col < high``; null values drop. The filter reaches the file scan."""
    c = F.col(range_col)
    return df.where((c >= F.lit(low)) & (c < F.lit(high))).select(*cols)


def scan_period(df: DataFrame, low: int, high: int, date_col: str) -> DataFrame:
    """Rows dated in ``[low, high)`` epoch nanoseconds, whatever type the date is stored in; null dates drop.

    The bounds are turned into the stored type (bigint nanoseconds, ``timestamp_ntz`` or date) and the column stays bare, so the
    range reaches the file scan; a range over the converted column would not. A zoned timestamp is an error.
    """
    epoch = dt.datetime(1970, 1, 1)
    stored = df.schema[date_col].dataType
    if isinstance(stored, T.LongType):
        unit, literal = 1, F.lit
    elif isinstance(stored, T.TimestampNTZType):
        unit, literal = 1000, lambda us: F.expr(f"timestamp_ntz'{epoch + dt.timedelta(microseconds=us)}'")
    elif isinstance(stored, T.DateType):
        unit, literal = DAY_NS, lambda days: F.lit((epoch + dt.timedelta(days=days)).date())
    else:
        raise TypeError(f"{date_col} is {stored.simpleString()}, not bigint, timestamp_ntz or date")
    # A whole number of units is at or above a bound exactly if it is at or above the bound rounded up.
    first, end = (literal(-(-bound // unit)) for bound in (low, high))
    return df.where((F.col(date_col) >= first) & (F.col(date_col) < end))


def scan_in(df: DataFrame, cols: Sequence[str], keys: DataFrame | Sequence, key_col: str) -> DataFrame:
    """Rows whose key is in a set: a short Python list, or the first column of a DataFrame of any size."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias(key_col))
        return df.join(wanted, key_col, "left_semi").select(*cols)
    return df.where(F.col(key_col).isin(list(keys))).select(*cols)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Cast to an explicit schema given as DDL; a missing column is an error, others are dropped."""
    wanted = T.StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def papers_schema(
    n_features: int,
    id_col: str = "id",
    refs_col: str = "refs",
    date_col: str = "publication_date_int",
    y_cols: Sequence[str] = (),
    prefix: str = "embedding_",
) -> str:
    """DDL of a converted papers table; leave ``y_cols`` empty for the label-free form."""
    fields = [f"`{id_col}` bigint", f"`{refs_col}` array<bigint>", f"`{date_col}` bigint"]
    fields += [f"`{c}` int" for c in y_cols]
    fields += [f"`{c}` float" for c in feature_columns(n_features, prefix)]
    return ", ".join(fields)


def convert_references(
    raw: DataFrame, text_col: str, schema: str, refs_col: str = "refs", mode: str = "strict", prefix: str = WORK_PREFIX
) -> DataFrame:
    """Reference text to ``array<bigint>`` and every column cast to ``schema``; a narrow plan."""
    parsed = raw.withColumn(refs_col, parse_reference_list(F.col(text_col), mode, prefix))
    return conform(parsed, schema)


def write_papers(df: DataFrame, path: str, dictionary_col: str | None = "refs", mode: str = "overwrite") -> None:
    """Snappy Parquet, dictionary pages for the list column."""
    writer = df.write.mode(mode).option("compression", "snappy")
    if dictionary_col:
        writer = writer.option(f"parquet.enable.dictionary#{dictionary_col}.list.element", "true")
    writer.parquet(path)


def repeated_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids held by more than one row, with their count."""
    return df.groupBy(id_col).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, id_col: str = "id") -> None:
    """An error when an id is repeated; runs one job."""
    first = repeated_ids(df, id_col).first()
    if first is not None:
        raise ValueError(f"{id_col} {first[0]} appears {first['n_rows']} times")
