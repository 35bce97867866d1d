import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeframe.llm import queries, vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    data = np.array([np.floor(256 * np.array(v, np.float64)) for _, v in kept]).astype(np.int64).reshape(len(kept), parts, -1)
    books = data[:entries].copy()

    def near(p):
        return ((data[:, p, None, :] - books[None, :, p, :]) ** 2).sum(axis=2)

    for _ in range(rounds):
        new = books.copy()
        for p in range(parts):
            at = near(p).argmin(axis=1)
            for e in range(len(books)):
                if (at == e).any():
                    new[e, p] = data[at == e, p].sum(axis=0) // (at == e).sum()
        books = new
    far = np.stack([near(p).min(axis=1) for p in range(parts)], axis=1)
    code = np.stack([near(p).argmin(axis=1) for p in range(parts)], axis=1)
    text = ",".join(str(x) for x in books.transpose(1, 0, 2).reshape(-1))
    return {kept[i][0]: (code[i].astype(np.uint8).tobytes(), int(far[i].sum())) for i in range(len(kept))}, hashlib.sha256(text.encode()).hexdigest()


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("code", F.lit("clash"))
    done = vector_codes.compress(spark, table.repartition(3), **options)
    return {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in done.coded.collect()}, done.digest()


@pytest.mark.parametrize("spread", [0.002, 0.2, 3.0])
def test_codes_equal_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 32))
    data = (centres[rng.integers(0, 20, 900)] + rng.normal(0, spread, (900, 32))).astype(np.float32)
    data[100:300] = data[5]
    rows = [(int(i) * 3, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(1, None), (2, [float("nan")] * 32), (4, [None] * 32), (5, [float("inf")] + [0.0] * 31)]
    assert found(spark, rows) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5, -0.5] * 16) for i in range(10)]
    codes, digest = found(spark, rows)
    assert (codes, digest) == brute(rows)
    assert set(codes.values()) == {(bytes(16), 0)}
    assert found(spark, []) == ({}, hashlib.sha256(b"").hexdigest())
    assert found(spark, [(1, None)])[0] == {}
    assert found(spark, [(1, [])])[0] == {1: (bytes(16), 0)}
    with pytest.raises(ValueError, match="equal parts"):
        found(spark, [(1, [0.0] * 17)])


def test_subtrees_are_assigned_whole(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-40, 40, (2000, 4)), rng.integers(4000, 4080, (2000, 4))])
    tree, place = vector_codes.cover_tree(points)
    entries = np.array([[0, 0, 0, 0], [4040, 4040, 4040, 4040], [0, 0, 0, 0]])
    seen = []
    squared = vector_codes._squared
    monkeypatch.setattr(vector_codes, "_squared", lambda a, b: (seen.append(len(a)), squared(a, b))[1])
    nearest = vector_codes.assign(tree, entries)
    assert sum(seen) < 20
    assert nearest[place].tolist() == squared(points, entries).argmin(axis=1).tolist()
    assert (tree.points[place] == points).all()
    counts, sums = vector_codes.entry_sums(tree, nearest, 3)
    assert counts.tolist() == [2000, 2000, 0]
    assert sums[0].tolist() == points[:2000].sum(axis=0).tolist()


def test_query_sums_errors_over_labels(spark, sf):
    rows = queries.op13_vector_codes(spark, sf).collect()
    kept = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    codes, digest = brute([(r[0], r[1]) for r in kept])
    assert {r["vec_id"]: (bytes.fromhex(r["code"]), r["error"]) for r in rows} == codes
    assert {r["codebooks_sha256"] for r in rows} == {digest}
    labels = {}
    for r in rows:
        labels.setdefault(r["label_error"], []).append(r["error"])
    assert all(sum(v) == k or sum(v) % k == 0 for k, v in labels.items())
