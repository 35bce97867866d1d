import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeframe.functions import timeline as tl


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_ns_round_trip_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = [dt.datetime(1900, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 2, 29, 12)]
        df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
        ns = tl.to_epoch_ns(F.col("d"))
        rows = df.select(ns.alias("ns"), tl.from_epoch_ns(ns).alias("back"), tl.year_to_ns(F.year("d")).alias("y")).collect()
        assert [r["back"] for r in rows] == days
        assert rows[0]["ns"] == -2208988800000000000 == tl.year_start_ns(1900)
        assert [r["y"] for r in rows] == [tl.year_start_ns(d.year) for d in days]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_nanoseconds_before_the_epoch_stay_in_their_year(spark):
    ns = tl.year_start_ns(1970) - 1
    df = spark.createDataFrame([(ns,)], "ns bigint")
    assert df.select(tl.year_of_ns(F.col("ns")).alias("y")).first()["y"] == 1969


def test_sizes():
    assert tl.example_bytes(50, 384) == 2_506_752
    assert tl.rows_per_shard(4_718_592_000, 50, 384) == 1882
    with pytest.raises(MemoryError):
        tl.rows_per_shard(1000, 50, 384)
    assert (tl.ceil_div(10, 3), tl.ceil_div(9, 3)) == (4, 3)


def test_interval_of_foreign_names(spark):
    df = spark.createDataFrame([("/a/b/-10_20_shard_3.tfrecord",), ("5_6_shard_0",)], "p string")
    low, high = tl.interval_from_name(F.col("p"))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(-10, 20), (5, 6)]


def test_ceil_div_column(spark):
    df = spark.createDataFrame([(0,), (1,), (512,), (513,)], "n bigint")
    assert [r[0] for r in df.select(tl.ceil_div_col(F.col("n"), 512)).collect()] == [0, 1, 1, 2]


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "Asia/Beirut", "America/New_York", "UTC"])
def test_values_in_a_daylight_saving_gap(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        gaps = [dt.datetime(2018, 11, 4, 0, 30), dt.datetime(2020, 3, 29, 0, 15, 0, 7), dt.datetime(2020, 3, 8, 2, 30), dt.datetime(1950, 1, 1, 1, 2, 3, 4)]
        df = spark.createDataFrame([(d,) for d in gaps], "d timestamp_ntz").select("d", tl.to_epoch_us(F.col("d")).alias("us"))
        assert [r["us"] for r in df.collect()] == [(d - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for d in gaps]
        back = df.select(tl.from_epoch_ns(F.col("us") * 1000).alias("back"))
        assert [r["back"] for r in back.collect()] == gaps
        assert "as timestamp)" not in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
