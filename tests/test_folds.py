import pytest
from pyspark.sql import functions as F

from citeframe.functions.timeline import DAY_NS, year_start_ns
from citeframe.operators import folds as fo
from citeframe.operators.slicing import select_shards, time_slices

DEFAULTS = dict(start_year=1900, end_year=2020, start_train=100, val_size=5, test_size=1, delta=1)


@pytest.fixture(scope="module")
def papers(spark):
    """One paper at each fold bound of the year 2006, one nanosecond before it, and each 1 January."""
    f = fo.make_folds(**DEFAULTS)[0]
    dates = {b + d for b in (f.train_start, f.val_start, f.test_start, f.test_end) for d in (-1, 0)}
    dates |= {year_start_ns(y) for y in range(1998, 2009)}
    return spark.createDataFrame(list(enumerate(sorted(dates))), "id bigint, publication_date_int bigint")


def test_default_folds():
    folds = fo.make_folds(**DEFAULTS)
    assert [f.end_year for f in folds] == list(range(2006, 2020))
    first = folds[0]
    assert first.train_start == year_start_ns(1900)
    assert first.test_end == year_start_ns(2006)
    assert first.test_start == year_start_ns(2005) + 1 * DAY_NS  # 2005-01-02
    assert first.val_start == year_start_ns(2000) + 8 * DAY_NS  # 2000-01-09


def test_step_and_size_rule():
    assert [f.end_year for f in fo.make_folds(1900, 2020, 100, 5, 2, 4)] == [2007, 2011, 2015, 2019]
    with pytest.raises(ValueError):
        fo.make_folds(1900, 2020, 100, 5, 2, 1)


def test_exclusive_roles_are_half_open_and_disjoint(papers):
    f = fo.make_folds(**DEFAULTS)[:1]
    dates = {r["id"]: r["publication_date_int"] for r in papers.collect()}
    got = {}
    for r in fo.assign_roles(papers, f).collect():
        assert r["id"] not in got
        got[r["id"]] = r["role"]
    for i, d in dates.items():
        want = next((role for role in fo.ROLES if f[0].window(role)[0] <= d < f[0].window(role)[1]), None)
        assert got.get(i) == want
    assert all(r["n_leaked"] == 0 for r in fo.leakage_audit(papers, fo.make_folds(**DEFAULTS)).collect())


def test_overlap_puts_boundary_slices_in_two_roles(papers):
    sliced = time_slices(papers, 1900, 2024)
    f = fo.make_folds(**DEFAULTS)[:1]
    roles = fo.assign_roles(sliced, f, "overlap").join(sliced, "id")
    year = F.year(F.timestamp_micros((F.col("slice_start") / 1000).cast("bigint")))
    rows = roles.select(year.alias("year"), "role").distinct().collect()
    held = {y: {r["role"] for r in rows if r["year"] == y} for y in range(1998, 2008)}
    assert held[1999] == {"train"} and held[2000] == {"train", "val"} and held[2001] == {"val"}
    # The slice of 2004 ends before the test window starts on 2005-01-02; that of 2006 touches its end.
    assert held[2004] == {"val"} and held[2005] == {"val", "test"} and held[2006] == {"test"} and held[2007] == set()
    audit = fo.leakage_audit(sliced, f, "overlap").first()
    n = {y: sliced.where(year == y).count() for y in (2000, 2005)}
    assert (audit["train_val"], audit["val_test"], audit["train_test"]) == (n[2000], n[2005], 0)
    assert audit["n_leaked"] == n[2000] + n[2005]


def test_fold_table_counts_roles(papers):
    folds = fo.make_folds(**DEFAULTS)
    counts = fo.assign_roles(papers, folds).groupBy("fold").pivot("role", list(fo.ROLES)).count().na.fill(0)
    want = {r["fold"]: (r["train"], r["val"], r["test"]) for r in counts.collect()}
    for r in fo.fold_table(papers, folds).collect():
        assert (r["n_train"], r["n_val"], r["n_test"]) == want.get(r["fold"], (0, 0, 0))


def test_last_slice_may_pass_the_end(spark):
    rows = [(i, year_start_ns(y)) for i, y in enumerate((1899, 1900, 1904, 1905, 1909, 1910))] + [(9, None)]
    df = spark.createDataFrame(rows, "id bigint, publication_date_int bigint")
    got = {r["id"]: (r["slice_start"], r["slice_end"]) for r in time_slices(df, 1900, 1908, 5).collect()}
    early, late = (year_start_ns(1900), year_start_ns(1905)), (year_start_ns(1905), year_start_ns(1910))
    assert got == {1: early, 2: early, 3: late, 4: late}


def test_shard_choice_at_the_bounds(spark):
    manifest = spark.createDataFrame([(0, 10, 0, 5), (10, 20, 0, 5), (20, 30, 0, 5)], "slice_start bigint, slice_end bigint, shard int, n_examples bigint")
    starts = lambda df: sorted(r["slice_start"] for r in df.collect())
    assert starts(select_shards(manifest, 10, 20)) == [0, 10, 20]
    assert starts(select_shards(manifest, 10, 20, "exclusive")) == [10]
    with pytest.raises(ValueError):
        select_shards(manifest, 0, 1, "other")


def test_a_planted_leak_is_counted(spark):
    fold = fo.make_folds(2000, 2006, 2, 1, 1)[0]
    train, val, test = fold.train_start, fold.val_start, fold.test_start
    papers = spark.createDataFrame([(1, train), (2, train), (3, val), (4, train), (5, None)], "id bigint, publication_date_int bigint")
    schema = "id bigint, ref_date bigint"
    clean = spark.createDataFrame([(1, train), (2, None), (3, test), (5, test), (9, test)], schema)
    assert [tuple(r) for r in fo.reference_leakage(papers, clean, [fold]).collect()] == [(fold.end_year, 0, 0, 0)]
    leaks = spark.createDataFrame([(1, val), (1, test), (1, test), (4, fold.test_end - 1), (2, fold.test_end)], schema)
    found = fo.reference_leakage(papers, clean.union(leaks), [fold]).collect()
    assert [tuple(r) for r in found] == [(fold.end_year, 1, 3, 2)]
    empty = fo.reference_leakage(papers.limit(0), clean.limit(0), [fold]).collect()
    assert [tuple(r) for r in empty] == [(fold.end_year, 0, 0, 0)]
