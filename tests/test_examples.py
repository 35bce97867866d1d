"""Hand-made papers: every edge case of the example layout."""

import pytest
from pyspark.sql import functions as F

from citeframe.functions import vectors as vec
from citeframe.operators.citations import explode_references, rank_references, reference_dates
from citeframe.operators.sequences import build_examples

K, N, PAD = 2, 2, -1.0
P = [PAD, PAD]
PAPERS = [
    # id, date, refs, label
    (1, 10, None, 1),
    (2, 20, [], 0),
    (3, 30, [1], None),
    (4, 40, [99], 1),  # only a work outside the table
    (5, 50, [1, 1], 1),  # a repeat takes two ranks
    (6, 60, [3, 2, 1], 0),  # more than K: the oldest stay
    (7, None, [1], 0),
    (8, 80, [7, 2], 0),  # a reference without a date comes last
    (9, 20, [], 0),
    (10, 90, [9, 2], 0),  # same date: lower id first
    (11, 95, [12], 0),  # the cited paper has a null element
    (12, 96, [None, 13, 1], 0),  # a null reference, and one without a vector
    (13, 5, [13], 0),  # cites itself
]
VECTORS = [(i, [float(i), i + 0.5]) for i in range(1, 12)] + [(12, [12.0, None])]


def v(i):
    return {12: [12.0, PAD], 13: P}.get(i, [float(i), i + 0.5])


EXPECTED = {
    1: P + P + v(1),
    2: P + P + v(2),
    3: P + v(1) + v(3),
    4: P + P + v(4),
    5: v(1) + v(1) + v(5),
    6: v(2) + v(1) + v(6),
    7: P + v(1) + v(7),
    8: v(7) + v(2) + v(8),
    9: P + P + v(9),
    10: v(9) + v(2) + v(10),
    11: P + v(12) + v(11),
    12: v(1) + v(13) + v(12),
    13: P + v(13) + v(13),
}


@pytest.fixture(scope="module")
def toy(spark):
    papers = spark.createDataFrame(PAPERS, "id bigint, publication_date_int bigint, refs array<bigint>, label int")
    vectors = spark.createDataFrame(VECTORS, "id bigint, embedding array<float>")
    return papers, vectors


def features(df):
    return {r["id"]: list(r["features"]) for r in df.collect()}


def test_layout(toy):
    papers, vectors = toy
    rows = build_examples(papers, vectors, K, N, ["label"], pad=PAD)
    assert features(rows) == EXPECTED
    assert {r["id"]: r["target"][0] for r in rows.collect()} == {p[0]: p[3] for p in PAPERS}
    assert {r["id"]: r["publication_date_int"] for r in rows.collect()} == {p[0]: p[1] for p in PAPERS}


def test_range_looks_references_up_in_the_whole_table(toy):
    papers, vectors = toy
    rows = build_examples(papers, vectors, K, N, ["label"], pad=PAD, low=50, high=90)
    assert features(rows) == {i: EXPECTED[i] for i in (5, 6, 8)}


def test_result_does_not_depend_on_partitions(toy):
    papers, vectors = toy
    for n in (1, 7):
        rows = build_examples(papers.repartition(n), vectors.repartition(n, "id"), K, N, ["label"], pad=PAD)
        assert features(rows) == EXPECTED


def test_group_keys_travel_with_the_examples(toy):
    papers, vectors = toy
    focal = papers.withColumn("part", (F.col("id") % 3).cast("int"))
    rows = build_examples(papers, vectors, K, N, ["label"], pad=PAD, focal=focal, group_keys=["part"])
    assert features(rows) == EXPECTED
    assert all(r["part"] == r["id"] % 3 for r in rows.collect())


def test_examples_laid_out_by_paper_equal_those_of_one_group(spark):
    """Repeated papers and vectors, null ids, a list that is too long and a focal paper outside the table."""
    papers = spark.createDataFrame(
        [(1, 10, [2], 1), (1, 10, [2], 1), (2, 20, None, None), (2, 25, [1, 3], 0), (3, 30, [1, 2, 2, 9], 0), (None, 40, [1], 1)],
        "id bigint, publication_date_int bigint, refs array<bigint>, label int",
    )
    outside = spark.createDataFrame([(8, 80, [3, 1], 1)], papers.schema)
    vectors = spark.createDataFrame(
        [(1, [1.0, 1.5]), (2, [2.0, None]), (2, [2.5, 2.5]), (None, [7.0, 7.0])], "id bigint, embedding array<float>"
    )
    focal = papers.union(outside).withColumn("part", F.lit(0))
    options = dict(y_cols=["label"], pad=PAD, filter_vectors=False)
    lie = build_examples(papers, vectors, K, N, focal=focal, **options)
    grouped = build_examples(papers, vectors, K, N, focal=focal, group_keys=["part"], **options)
    got, want = (sorted(map(str, rows.select(*lie.columns).collect())) for rows in (lie, grouped))
    assert got == want and len(got) == 5


def test_filled_labels(toy):
    papers, vectors = toy
    rows = build_examples(papers, vectors, K, N, ["label"], fill_labels=0.0)
    assert {r["target"][0] for r in rows.where("id = 3").collect()} == {0.0}


def test_no_timepoints_leaves_the_paper_alone(toy):
    papers, vectors = toy
    rows = build_examples(papers, vectors, 0, N, ["label"], pad=PAD)
    assert features(rows) == {p[0]: v(p[0]) for p in PAPERS}


def test_wrong_vector_width_is_an_error(toy, spark):
    papers, _ = toy
    short = spark.createDataFrame([(1, [1.0])], "id bigint, embedding array<float>")
    with pytest.raises(Exception, match="vector width 1"):
        build_examples(papers, short, K, N).collect()


def test_edges_and_ranks(toy):
    papers, _ = toy
    edges = explode_references(papers)
    assert sorted((r[0], r[1]) for r in edges.where("id = 5").collect()) == [(5, 1), (5, 1)]
    assert edges.where("id in (1, 2)").count() == 0
    ranked = rank_references(reference_dates(edges, papers), K)
    got = {(r["id"], r["ref_rank"]): r["ref_id"] for r in ranked.collect()}
    assert got[(8, 0)] == 2 and got[(8, 1)] == 7
    assert got[(10, 0)] == 2 and got[(10, 1)] == 9
    assert (6, 2) not in got and (4, 0) not in got


def test_unflatten_and_wide_names(toy):
    papers, vectors = toy
    rows = build_examples(papers, vectors, K, N, pad=PAD).where("id = 6")
    steps = rows.select(vec.unflatten(F.col("features"), K, N).alias("s")).first()["s"]
    assert steps == [v(2), v(1), v(6)]
    wide = rows.select(*vec.wide_step_columns(F.col("features"), K, N))
    assert wide.columns == [
        "embedding_0_1", "embedding_1_1", "embedding_0_0", "embedding_1_0", "embedding_0", "embedding_1",
    ]
    assert list(wide.first()) == v(2) + v(1) + v(6)


def test_checked_width(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "features array<float>")
    assert df.select(vec.checked_width(F.col("features"), 0, 2).alias("f")).first()["f"] == [1.0, 2.0]
    with pytest.raises(Exception, match="example width 2"):
        df.select(vec.checked_width(F.col("features"), 1, 2)).collect()


def test_clean_vector_with_extreme_values(spark):
    inf = float("-inf")
    df = spark.createDataFrame([(1, [inf, None]), (2, [1.0, inf]), (3, None)], "i int, e array<float>")
    rows = df.select("i", vec.clean_vector(F.col("e"), 2, 0.0).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in rows] == [[inf, 0.0], [1.0, inf], [0.0, 0.0]]


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],)], "e array<float>")
    assert df.select(*vec.unpack("e", 3)).select(vec.pack(3).alias("e")).first()["e"] == [1.0, None, 3.0]
