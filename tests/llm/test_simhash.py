import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citeframe.llm import queries, simhash

SCHEMA = "doc_id bigint, text string"


def plain_fingerprint(text, width=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points, ids, bits=3):
    """Least id of each point's component, by comparing every pair."""
    n, root = len(points), list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def test_fingerprints():
    texts = ["", "one", "Two words", "a B c", "a b\tc\x0bd  e\nf É é", "x " * 70000, " lead and trail ", "nb sp  em"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text)


def near_points(rng, centres=60, around=8, spread=4):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            x = c
            for _ in range(rng.randrange(spread + 1)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out) | {0, (1 << 64) - 1, 1, 3, 7, 15})


@pytest.mark.parametrize("block", [100_000, 7])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    points = near_points(random.Random(5))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    found = simhash.links(spark, spark.createDataFrame([(s,) for s in signed], "fingerprint bigint")).collect()
    root = {s: s for s in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    groups = {}
    for s in signed:
        groups.setdefault(find(s), set()).add(s)
    want = {}
    for s, c in zip(signed, plain_components(points, list(range(len(points)))), strict=True):
        want.setdefault(c, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_probing_and_comparing_agree():
    rng = random.Random(11)
    prints = np.array(near_points(rng, 30, 20, 3), np.uint64)
    counts = simhash.segment_counts(prints)
    packed = ((counts + 3) << (4 * np.arange(8))).sum(axis=1)
    rows, steps = np.arange(len(prints)), np.concatenate(list(simhash.displacements(3).values()))
    assert len(steps) == 833
    one, two = simhash.Forest(len(prints)), simhash.Forest(len(prints))
    simhash._link_directly(one, prints, rows, rows, 3)
    simhash._link_by_probes(two, prints, packed, rows, rows, steps, 3)
    assert (one.label == two.label).all()


def test_bit_counts_bound_the_distance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    apart = np.abs(simhash.segment_counts(a) - simhash.segment_counts(b)).sum(axis=1)
    assert (apart <= np.bitwise_count(a ^ b)).all()


def test_documents_with_nulls_copies_and_no_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the loud village " * 6
    rows = [(5, base), (3, base), (3, base), (9, base.replace("loud", "calm", 1)), (None, base), (7, ""), (8, None), (11, "other words here")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fingerprint", F.lit("clash")).withColumn("cluster", F.lit(1))
    found = simhash.near_duplicates(spark, docs).collect()
    points, ids = [plain_fingerprint(t) for _, t in rows], [i for i, _ in rows]
    want = sorted(zip(ids, points, plain_components(points, ids), strict=True), key=str)
    assert sorted(((r.id, r.fingerprint % (1 << 64), r.component_id) for r in found), key=str) == want
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    n = len({c for *_, c in want})
    assert kept.count() == n
    assert {r.doc_id for r in kept.collect()} == {c for *_, c in want}
    empty = simhash.near_duplicates(spark, docs.limit(0))
    assert empty.count() == 0


def test_query_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    points, ids = [plain_fingerprint(r.text) for r in docs], [r.doc_id for r in docs]
    want = sorted((i, f"{p:016x}", c) for i, p, c in zip(ids, points, plain_components(points, ids), strict=True))
    assert sorted(map(tuple, queries.op10_simhash_near_dedup(spark, sf).collect())) == want
