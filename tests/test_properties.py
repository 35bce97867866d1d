"""Random papers against a plain Python version of the example rules."""

import random

import pytest

from citeframe.functions.timeline import year_start_ns
from citeframe.operators.sequences import build_examples
from citeframe.operators.slicing import time_slices
from citeframe.plans.export import sharded_examples


def random_papers(seed, n=300):
    rng = random.Random(seed)
    papers = []
    for i in range(n):
        refs = None if rng.random() < 0.1 else [rng.choice([rng.randrange(n), 0, n + 5, None]) for _ in range(rng.randrange(9))]
        date = None if rng.random() < 0.05 else year_start_ns(1995 + rng.randrange(8)) + rng.randrange(3)
        label = rng.choice([0, 1, None])
        papers.append((i, date, refs, label))
    vectors = [
        (i, None if rng.random() < 0.1 else [None if rng.random() < 0.1 else float(rng.randrange(100)) for _ in range(3)])
        for i in range(n)
        if rng.random() < 0.95
    ]
    return papers, vectors


def expected(papers, vectors, k, pad):
    dates = {p[0]: p[1] for p in papers}
    vecs = dict(vectors)

    def vector(i):
        v = vecs.get(i)
        return [pad] * 3 if v is None else [pad if x is None else x for x in v]

    out = {}
    for i, _, refs, _ in papers:
        known = [r for r in refs or [] if r in dates]
        oldest = sorted(known, key=lambda r: (dates[r] is None, dates[r] or 0, r))[:k]
        flat = [pad] * (3 * (k - len(oldest)))
        for r in reversed(oldest):
            flat += vector(r)
        out[i] = flat + vector(i)
    return out


@pytest.mark.parametrize(("seed", "k", "pad"), [(1, 4, 0.0), (2, 1, -7.0), (3, 12, 0.5)])
def test_examples_match_the_rules(spark, seed, k, pad):
    papers, vectors = random_papers(seed)
    p = spark.createDataFrame(papers, "id bigint, publication_date_int bigint, refs array<bigint>, label int").repartition(4)
    v = spark.createDataFrame(vectors, "id bigint, embedding array<float>").repartition(3)
    want = expected(papers, vectors, k, pad)
    rows = build_examples(p, v, k, 3, ["label"], pad).collect()
    assert len(rows) == len(papers)
    assert {r["id"]: r["features"] for r in rows} == want
    assert {r["id"]: r["target"] for r in rows} == {i: [label] for i, _, _, label in papers}

    sharded = sharded_examples(p, v, 1995, 2003, 1, 10, k, 3, ["label"], pad).collect()
    chunked = sharded_examples(p, v, 1995, 2003, 1, 10, k, 3, ["label"], pad, max_rows=20).collect()
    assert sorted(map(str, chunked)) == sorted(map(str, sharded))
    dated = {i for i, date, _, _ in papers if date is not None}
    assert {r["id"]: r["features"] for r in sharded} == {i: want[i] for i in dated}
    sizes = {}
    for r in sharded:
        key = (r["slice_start"], r["shard"])
        sizes[key] = sizes.get(key, 0) + 1
        assert r["slice_start"] <= r["publication_date_int"] < r["slice_end"]
    for start in {s for s, _ in sizes}:
        counts = [sizes[(start, i)] for i in range(sum(s == start for s, _ in sizes))]
        assert all(c == 10 for c in counts[:-1]) and 1 <= counts[-1] <= 10


def test_slice_of_every_year(spark):
    years = list(range(1900, 2024))
    rows = [(i, year_start_ns(y) + d) for i, y in enumerate(years) for d in (0, year_start_ns(y + 1) - year_start_ns(y) - 1)]
    df = spark.createDataFrame(rows, "id bigint, publication_date_int bigint")
    for r in time_slices(df, 1900, 2024).collect():
        assert (r["slice_start"], r["slice_end"]) == (year_start_ns(years[r["id"]]), year_start_ns(years[r["id"]] + 1))
