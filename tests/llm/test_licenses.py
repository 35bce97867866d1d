import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeframe.llm import licenses, queries
from citeframe.llm.license_texts import TEMPLATES

SCHEMA = "doc_id bigint, text string"


def plain_words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.lower())


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(row[j], row[j - 1])
            left = up
    return row[-1]


def noise(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_words_and_hashes():
    raw = "Héllo, WORLD world a_b 12.5 É é".encode()
    hashes, start, end = licenses.words(np.frombuffer(raw, np.uint8))
    found = [raw[a:b].decode() for a, b in zip(start, end, strict=True)]
    assert found == ["Héllo", "WORLD", "world", "a", "b", "12", "5", "É", "é"]
    assert hashes[1] == hashes[2] and len(set(hashes.tolist())) == 8


@pytest.mark.parametrize("gap", [1, 4, 9])
def test_copied_runs_share_a_fingerprint(gap):
    rng = np.random.default_rng(gap)
    shared = rng.integers(0, 1 << 60, licenses.GRAM + licenses.WINNOW - 1, dtype=np.uint64)
    sides = [np.concatenate([rng.integers(0, 1 << 60, gap, dtype=np.uint64), shared, rng.integers(0, 1 << 60, 7, dtype=np.uint64)]) for _ in "ab"]
    one, two = (set(licenses.fingerprints(s, np.zeros(len(s), int))[0].tolist()) for s in sides)
    assert one & two


def test_alignment_counts_the_common_words():
    rng = random.Random(5)
    for _ in range(60):
        t = [rng.randrange(30) for _ in range(rng.randrange(1, 25))]
        x = [w for w in t if rng.random() < 0.85]
        for _ in range(rng.randrange(3)):
            x.insert(rng.randrange(len(x) + 1), 99)
        got = licenses.align(np.array(t), np.array(x), 0)
        assert len(got) == common(t, x) and got == sorted(got)
        assert common([x[i] for i in got], t) == len(got)


def test_edited_notices_and_their_spans(spark):
    rng = random.Random(1)
    rows = [(None, None), (0, ""), (1, noise(rng, 50))]
    for i, (name, text) in enumerate(TEMPLATES.items()):
        words = text.split()
        edited = [w for k, w in enumerate(words) if k % 13 != 6 or len(words) < 12]
        rows += [(10 + i, f"é {noise(rng, 30)}.\n{text}\n{noise(rng, 30)}"), (100 + i, f"{noise(rng, 9)} {' '.join(edited).upper()} {noise(rng, 5)}")]
        half = " ".join(words[: len(words) // 2])
        rows.append((200 + i, half))
    rows += [(300, TEMPLATES["MIT/statement"] + " and " + TEMPLATES["MIT/statement"])] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("license", F.lit("clash")).repartition(3)
    found = licenses.scan(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    texts = dict(rows)
    for doc_id, text in texts.items():
        want = {}
        for name, t in TEMPLATES.items():
            # A template's words within the reach of the band.
            a, b = plain_words(t), plain_words(text or "")
            best = max((common(a, b[k : k + len(a) + 8]) for k in range(max(1, len(b) - len(a) - 7))), default=0)
            if best >= 0.8 * len(a):
                want[name] = best
        assert {r.license: r.matched_words for r in by.get(doc_id, [])} == want, (doc_id, text)
    for r in found:
        said = plain_words(" ".join(texts[r.doc_id][s.start : s.end] for s in r.spans))
        assert len(said) == r.matched_words and common(said, plain_words(TEMPLATES[r.license])) == len(said)
    assert len(by[300]) == 4


def test_more_templates_than_one_pass_takes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, TEMPLATES["MIT/statement"]), (2, TEMPLATES["ISC/text"])], SCHEMA)
    want = sorted(licenses.scan(docs).select("doc_id", "license").collect())
    monkeypatch.setattr(licenses, "BLOCK", 40)
    assert sorted(licenses.scan(docs).select("doc_id", "license").collect()) == want == [(1, "MIT/statement"), (2, "ISC/text")]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, {}).count() == 0


def test_query_finds_the_statements(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {n: t for n, t in TEMPLATES.items() if n.endswith("/statement")}
    want = sorted((r.doc_id, n) for r in docs for n, t in short.items() if t in (r.text or ""))
    found = queries.op6_license_scan(spark, sf).collect()
    assert want and sorted((r.doc_id, r.license) for r in found if r.coverage == 1) == want
