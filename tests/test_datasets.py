import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citeframe.functions.references import WORK_PREFIX
from citeframe.functions.timeline import DAY_NS
from citeframe.sources import datasets as ds
from citeframe.sources import scratch


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(1, 10, f"['{WORK_PREFIX}2']", 1, 0.5, 1.5), (2, 20, None, 0, None, 2.5), (3, None, "[]", None, 3.5, 4.5)]
    schema = "id int, publication_date_int bigint, referenced string, label int, embedding_0 double, embedding_1 double"
    return spark.createDataFrame(rows, schema)


def test_convert_write_and_read_back(spark, raw):
    path = scratch.new_path(spark, "papers")
    converted = ds.convert_references(raw, "referenced", ds.papers_schema(2, y_cols=["label"]))
    ds.write_papers(converted, path)
    back = ds.open_dataset(spark, path)
    assert back.dtypes == [
        ("id", "bigint"), ("refs", "array<bigint>"), ("publication_date_int", "bigint"), ("label", "int"),
        ("embedding_0", "float"), ("embedding_1", "float"),
    ]
    assert [tuple(r) for r in back.orderBy("id").collect()] == [
        (1, [2], 10, 1, 0.5, 1.5), (2, [], 20, 0, None, 2.5), (3, [], None, None, 3.5, 4.5),
    ]
    assert back.inputFiles()[0].endswith(".snappy.parquet")


def test_the_label_free_schema_drops_the_label(raw):
    assert "label" not in ds.convert_references(raw, "referenced", ds.papers_schema(2)).columns


def test_a_missing_column_is_an_error(raw):
    with pytest.raises(ValueError, match="embedding_2"):
        ds.convert_references(raw, "referenced", ds.papers_schema(3))


@pytest.mark.parametrize("fmt", ["orc", "json"])
def test_other_formats(spark, raw, fmt):
    path = scratch.new_path(spark, fmt)
    raw.write.format(fmt).save(path)
    assert ds.scan_all(ds.open_dataset(spark, path, fmt), ["id"]).count() == 3


def test_range_is_half_open_and_drops_nulls(raw):
    got = ds.scan_range(raw, ["id"], 10, 20, "publication_date_int").collect()
    assert [r["id"] for r in got] == [1]


def test_membership_by_list_and_by_table(spark, raw):
    keys = spark.createDataFrame([(2,), (2,), (9,)], "k bigint")
    for wanted in (keys, [2, 9]):
        assert [r["id"] for r in ds.scan_in(raw, ["id"], wanted, "id").collect()] == [2]


def test_unique_ids(spark, raw):
    ds.assert_unique(raw)
    with pytest.raises(ValueError, match="id 1 appears 2 times"):
        ds.assert_unique(raw.unionByName(raw.where("id = 1")))


def test_scan_pushes_the_filter_and_prunes_columns(spark, sf):
    orders = ds.open_dataset(spark, f"{sf}/orders.parquet")
    df = ds.scan_range(orders, ["o_orderkey"], dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1), "o_orderdate")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_conversion_needs_no_python_and_no_shuffle(raw):
    plan = ds.convert_references(raw, "referenced", ds.papers_schema(2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch.new_path(spark, "x")
    assert path != scratch.new_path(spark, "x")
    assert path.startswith(named or spark.sparkContext.getCheckpointDir())


@pytest.mark.parametrize("kind", ["bigint", "timestamp_ntz", "date"])
def test_a_period_is_the_same_in_every_stored_type(spark, tmp_path, kind):
    days = spark.range(-3, 4).select("id", F.date_add(F.lit(dt.date(1970, 1, 1)), F.col("id").cast("int")).alias("day"))
    stored = F.col("day").cast("timestamp_ntz") if kind != "date" else F.col("day")
    rows = days.select("id", (F.col("id") * DAY_NS if kind == "bigint" else stored).alias("at")).union(spark.sql(f"SELECT 99L, cast(null AS {kind})"))
    rows.write.parquet(f"{tmp_path}/{kind}")
    rows = spark.read.parquet(f"{tmp_path}/{kind}")
    for low, high in [(0, DAY_NS), (-DAY_NS, 1), (-DAY_NS + 1, DAY_NS + 1), (1, 1), (-3 * DAY_NS - 1, 3 * DAY_NS)]:
        found = ds.scan_period(rows, low, high, "at")
        assert sorted(r["id"] for r in found.collect()) == [i for i in range(-3, 4) if low <= i * DAY_NS < high]
    assert "GreaterThanOrEqual(at," in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(TypeError, match="timestamp"):
        ds.scan_period(spark.sql("SELECT timestamp'2000-01-01' AS at"), 0, 1, "at")


def test_periods_of_slices_and_folds_reach_the_scan(spark, sf):
    for query in (entry.time_slices, entry.fold_roles):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00" in plan and "LessThan(o_orderdate," in plan
