"""Chunked windows must give exactly what one window gives, also with one hot group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from citeframe.operators import batches, history, metrics, slicing
from citeframe.operators.running import _split_hot, chunks_needed, cut_into_chunks, look_back, numbered, running


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; group 0 holds two thirds of them, one group key is null."""
    rng = random.Random(7)
    ids = list(range(3000))
    rng.shuffle(ids)
    rows = [(0 if i % 3 else (None if i % 5 == 0 else 1 + i % 4), i, rng.randint(-9, 9)) for i in ids]
    return spark.createDataFrame(rows, "g int, id bigint, x int").repartition(5)


def rows_of(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("keys", [["g"], []])
def test_running_sum_and_max(skewed, keys, before):
    measures = {"s": ("sum", F.col("x")), "m": ("max", F.struct("x", -F.col("id")))}
    args = (keys, [F.col("id")], measures, before)
    whole = running(skewed, *args, n_chunks=1)
    cut = running(skewed, *args, n_chunks=9)
    assert rows_of(whole) == rows_of(cut)


def test_descending_order(skewed):
    args = (["g"], [F.col("id").desc()], {"s": ("sum", F.col("x"))})
    assert rows_of(running(skewed, *args, n_chunks=1)) == rows_of(running(skewed, *args, n_chunks=6))


def test_numbers(skewed):
    w = Window.partitionBy("g").orderBy("id")
    want = skewed.withColumn("row_num", F.row_number().over(w).cast("bigint"))
    assert rows_of(want) == rows_of(numbered(skewed, ["g"], [F.col("id")], n_chunks=8))


def test_groups_decide_the_chunks(skewed):
    assert chunks_needed(skewed, ["g"], 2000) == 1
    assert chunks_needed(skewed, ["g"], 1999) == 2
    assert chunks_needed(skewed, ["g"], 100) == 30
    assert chunks_needed(skewed.where("false"), ["g"], 100) == 1


def test_chunks_are_even_and_ordered(skewed):
    sizes = cut_into_chunks(skewed, [], [F.col("id")], 10).groupBy("_chunk").agg(F.count("*").alias("n"), F.min("id"), F.max("id"))
    rows = sizes.orderBy("_chunk").collect()
    assert max(r["n"] for r in rows) <= 2 * 3000 / 10
    assert all(a["max(id)"] < b["min(id)"] for a, b in zip(rows, rows[1:], strict=False))


def test_one_crowded_position_is_cut_by_the_tie(skewed):
    """Two thirds of the rows share a position; the tie column, here against the row order, cuts them."""
    df = skewed.withColumn("t", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1500)).withColumn("e", -F.col("id"))
    order = [F.col("t"), F.col("e")]
    for keys in ([], ["g"]):
        whole = numbered(df, keys, order, n_chunks=1)
        assert rows_of(whole) == rows_of(numbered(df, keys, order, n_chunks=10))
    sizes = cut_into_chunks(df, [], order, 10).groupBy("_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 600
    assert cut_into_chunks(df, [], order[:1], 10).groupBy("_chunk").count().agg(F.max("count")).first()[0] >= 2000


@pytest.mark.parametrize("max_rows", [1, 7, 50, 400])
def test_look_back(skewed, max_rows):
    def add(df, w):
        gaps = df.withColumn("gap", F.col("id") - F.lag("id").over(w))
        return gaps.withColumn("mean", F.avg("gap").over(w.rowsBetween(-6, 0)))

    args = (["g"], [F.col("id")], 7, add)
    whole = look_back(skewed, *args, n_chunks=1)
    assert rows_of(whole) == rows_of(look_back(skewed, *args, n_chunks=5, max_rows=max_rows))


def test_shards_do_not_depend_on_chunks(skewed):
    sliced = skewed.select("id", F.coalesce("g", F.lit(9)).cast("bigint").alias("slice_start"), F.lit(1).alias("slice_end"))
    whole = slicing.assign_shards(sliced, 100, n_chunks=1)
    cut = slicing.assign_shards(sliced, 100, max_rows=150)
    assert rows_of(whole) == rows_of(cut)
    sizes = [r["n_examples"] for r in slicing.shard_counts(cut).collect()]
    assert max(sizes) == 100 and sum(sizes) == 3000


def test_batches_do_not_depend_on_chunks(skewed):
    for keys in ([], ["g"]):
        for seed in (None, 3):
            args = dict(batch_size=64, seed=seed, keys=keys)
            df = skewed.where("g is not null")
            assert rows_of(batches.batch_ids(df, **args, n_chunks=1)) == rows_of(batches.batch_ids(df, **args, n_chunks=7))


def test_pr_curve_does_not_depend_on_chunks(skewed):
    scored = skewed.select("g", (F.col("x") > 0).cast("int").alias("y"), (F.col("id") % 701 / 701).alias("p")).where("g is not null")
    for by in ([], ["g"]):
        whole = metrics.pr_curve(scored, by=by, n_chunks=1)
        assert rows_of(whole) == rows_of(metrics.pr_curve(scored, by=by, max_rows=50))


def test_history_does_not_depend_on_chunks(skewed, spark):
    events = skewed.where("g is not null").select(
        F.col("g").alias("user"), F.timestamp_add("SECOND", F.col("id") * F.col("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("ts"),
        "id", F.col("x").cast("double").alias("value"),
    )
    one = history.trial_log(events, "user", "ts", "id", "value", n_chunks=1)
    cut = history.trial_log(events, "user", "ts", "id", "value", n_chunks=6)
    assert rows_of(one) == rows_of(cut)
    for direction in ("max", "min"):
        assert rows_of(history.early_stop_epoch(one, 3, direction, n_chunks=1)) == rows_of(
            history.early_stop_epoch(one, 3, direction, n_chunks=6)
        )
        assert rows_of(history.flag_unpromising(one, direction=direction, n_chunks=1)) == rows_of(
            history.flag_unpromising(one, direction=direction, n_chunks=3)
        )
    assert rows_of(history.rolling_gap(events, "user", "ts", "id", 5, n_chunks=1)) == rows_of(
        history.rolling_gap(events, "user", "ts", "id", 5, max_rows=60)
    )


def test_only_hot_groups_are_cut(spark):
    rows = [(f"user-{i % 400 if i % 2 else 7}", f"id-{i:06d}", float(i % 13)) for i in range(4000)] + [("user-7", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id string, x double").repartition(4)
    args = (["g"], [F.col("id")], {"s": ("sum", F.col("x"))})
    whole = running(df, *args, n_chunks=1, totals=True)
    cut = running(df, *args, max_rows=100, totals=True)
    assert rows_of(whole) == rows_of(cut)
    _, hot = _split_hot(df, ["g"], 100)
    openers = cut_into_chunks(hot, ["g"], [F.col("id")], chunks_needed(hot, ["g"], 100)).select("g", "_chunk").distinct().count()
    assert openers <= df.count() / 100


def test_string_ids_and_missing_positions(spark):
    ids = spark.createDataFrame([(f"p{i:04d}é",) for i in range(500)] + [(None,), ("",)], "id string")
    assert rows_of(batches.batch_ids(ids, 32)) == rows_of(batches.batch_ids(ids, 32, max_rows=40))
    assert batches.batch_ids(ids, 32).count() == 502
    odd = spark.createDataFrame([(float(i),) for i in range(90)] + [(None,), (float("nan"),)], "id double")
    assert str(rows_of(batches.batch_ids(odd, 8))) == str(rows_of(batches.batch_ids(odd, 8, max_rows=10)))


@pytest.mark.parametrize("direction", ["max", "min"])
def test_string_trials_and_nan_scores(spark, direction):
    rows = [(f"t{t:02d}", e, float("nan") if (t + e) % 7 == 0 else (t * 37 + e * 11) % 19 / 19) for t in range(30) for e in range(12)]
    df = spark.createDataFrame(rows, "trial string, epoch bigint, score double")
    for f in (history.flag_unpromising, history.early_stop_epoch):
        assert rows_of(f(df, direction=direction)) == rows_of(f(df, direction=direction, max_rows=10))
    known = df.where("not isnan(score)")
    assert rows_of(history.early_stop_epoch(df, direction=direction)) == rows_of(history.early_stop_epoch(known, direction=direction))


def test_curve_without_nan(spark):
    rows = [(i % 2, [0.1, 0.3, 0.5, 0.7, float("nan")][i % 5]) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, p double")
    assert rows_of(metrics.pr_curve(df)) == rows_of(metrics.pr_curve(df, max_rows=2)) == rows_of(metrics.pr_curve(df.where("not isnan(p)")))


@pytest.mark.parametrize(
    "position",
    ["date_add(date'2000-01-01', id)", "timestamp'2000-01-01' + make_interval(0, 0, 0, id)", "cast(id * 1.000000001 as decimal(38, 12))",
     "cast(id as string)", "cast(id as double)", "make_date(2000, 1, 1 + id % 3)"],
)
@pytest.mark.parametrize("descending", [False, True])
def test_every_sortable_type_is_cut(spark, position, descending):
    """Nulls, NaN and repeated positions included; a third of the rows share one value."""
    ids = spark.range(0, 300, 1, 3).withColumn("id", F.col("id").cast("int"))
    odd = F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.expr(position))
    if "double" in position:
        odd = F.when(F.col("id") % 50 == 8, F.lit(float("nan"))).otherwise(odd)
    df = ids.select(F.when(F.col("id") % 3 == 0, F.first(F.expr(position)).over(Window.partitionBy())).otherwise(odd).alias("p"), "id")
    order = [F.col("p").desc() if descending else F.col("p"), F.col("id")]
    for keys in ([], ["g"]):
        rows = df.withColumn("g", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 2))
        measures = {"n": ("sum", F.lit(1)), "top": ("max", F.col("id"))}
        cut, whole = (rows_of(running(rows, keys, order, measures, **how)) for how in ({"max_rows": 20}, {"n_chunks": 1}))
        assert str(cut) == str(whole)  # NaN does not equal itself


def test_dates_and_decimals_make_batches_shards_and_trials(spark):
    days = spark.range(90).select(F.expr("date_add(date'2000-01-01', cast(id as int))").alias("id"), F.lit(1).alias("slice_start"), F.lit(2).alias("slice_end"))
    assert rows_of(batches.batch_ids(days, 8)) == rows_of(batches.batch_ids(days, 8, max_rows=10))
    assert rows_of(slicing.assign_shards(days, 8)) == rows_of(slicing.assign_shards(days, 8, max_rows=10))
    trials = days.select(F.col("id").cast("string").cast("date").alias("trial"), F.lit(0).cast("bigint").alias("epoch"), F.rand(3).alias("score"))
    trials = spark.createDataFrame(trials.collect(), trials.schema)
    assert rows_of(history.flag_unpromising(trials)) == rows_of(history.flag_unpromising(trials, max_rows=10))


def test_the_driver_gets_no_cuts(spark, monkeypatch):
    """The number of ranges is all that is handed to the exchange; nothing is collected but the size of the largest group."""
    seen = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (lambda rows: (seen.append(len(rows)), rows)[1])(collect(self)))
    running(spark.range(5000), [], [F.col("id")], {"s": ("sum", F.col("id"))}, max_rows=100)
    assert sum(seen) <= 1
