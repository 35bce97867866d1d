import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeframe.llm import queries, suffixes


def plain(texts, width=200):
    """(bytes, removed, runs, digest of the rest) of each text, by counting every window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        n_runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), n_runs, hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus():
    rng = random.Random(4)
    passages = [words(rng, n) for n in (25, 34, 35, 36, 40, 60, 200)]
    texts = ["", None, "short", "a" * 199, "b" * 200, "b" * 200, "c" * 201, "d" * 900, "xy" * 300, words(rng, 300)]
    for _ in range(60):
        parts = [words(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), words(rng, rng.randrange(0, 40))]
        texts.append(" ".join(parts))
    texts += texts[20:26] * 3
    near = texts[30].split(" ")
    for i in range(0, len(near), 37):
        texts.append(" ".join([*near[:i], "changed", *near[i + 1 :]]))
    whole = words(rng, 50)
    texts += [whole + words(rng, 1) + whole, whole[:199], whole[5:204], whole[5:205]]
    cut = words(rng, 31)[:190]  # an anchor in many spans, of which hardly any window repeats
    texts += [words(rng, 9) + cut + words(rng, 9) for _ in range(30)]
    return texts


def outcome(df):
    n = F.aggregate("removed", F.lit(0).cast("bigint"), lambda t, r: t + r["end"] - r["start"])
    rows = df.select("doc_id", F.octet_length("kept") + n, n, F.size("removed"), F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 1])
def test_same_as_counting_every_window(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    texts = corpus()
    docs = spark.createDataFrame([(i if i % 7 else None, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, kept int")
    docs = docs.withColumn("removed", F.lit("clash")).withColumn("key", F.lit(2)).repartition(5)
    want = sorted(((i if i % 7 else None, *x) for i, x in enumerate(plain(texts))), key=str)
    assert outcome(suffixes.remove_repeats(spark, docs.drop("kept", "removed"))) == want
    assert outcome(suffixes.remove_repeats(spark, docs)) == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffixes.remove_repeats(spark, docs).count() == 0


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = random.Random(8)
    shared = words(rng, 200).encode()
    a, b = b"some other beginning " + shared, words(rng, 77).encode() + shared + b" end"
    data = np.frombuffer(a + b, np.uint8)

    def anchor_of_windows():
        out = {}
        for _, at, first, n, _ in suffixes.spans(data, np.array([0, len(a), len(a) + len(b)])):
            for p, f, k in zip(at.tolist(), first.tolist(), n.tolist(), strict=True):
                for w in range(f, f + k):
                    out.setdefault(bytes(data[w : w + 200]), set()).add(p - w)
        return out

    whole = anchor_of_windows()
    assert all(len(x) == 1 for x in whole.values())
    assert len(whole) >= len(a) - 199
    monkeypatch.setattr(suffixes, "PIECE", 64)
    assert anchor_of_windows() == whole


def test_query_equals_counting_every_window(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(docs, plain([r.text for r in docs]), strict=True))
    assert sorted(map(tuple, queries.op3_suffix_array_dedup(spark, sf).collect())) == want


def test_a_sort_of_short_spans_takes_little_memory():
    """400,000 open spans of one window each, two to an anchor."""
    rng = np.random.default_rng(1)
    n = 400_000

    def batches():
        for start in range(0, n, 10_000):
            rows = [rng.bytes(suffixes.WINDOW) for _ in range(10_000)]
            rows[1] = rows[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(start, start + 10_000) // 2), pa.array([True] * 10_000), pa.array([b"k"] * 10_000, pa.binary()),
                    pa.array(np.arange(start, start + 10_000)), pa.array(np.zeros(10_000, np.int32)),
                    pa.array(np.ones(10_000, np.int32)), pa.array(rows, pa.binary()),
                ],
                ["gram", "single", "key", "a", "off", "n", "span"],
            )

    tracemalloc.start()
    found = [x for b in suffixes._sort_open(batches()) for x in b.column("a").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sorted([*range(0, n, 10_000), *range(1, n, 10_000)])
    assert peak < 100_000_000
