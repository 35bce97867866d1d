import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeframe.llm import pieces, queries, tokens

P = pieces.load(tokens.MODEL_FILE)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL_FILE)
PARTS = st.sampled_from(["a", "the", " ", "  ", " " * 5, " " * 7, " é", " 中", " \n", "ing", "中", "文", "é", "\U0001f600", "\n", "0", "00", "aaa", ".", "on", "er", "x", "\t"])
TEXTS = st.lists(PARTS, max_size=120).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_same_ids_as_the_library(text):
    assert P.encode(text).tolist() == LIBRARY.encode(text)
    assert P.decode(P.encode(text).tolist()) == text


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(20, 60))
def test_chunks_give_the_same_ids(text, size):
    marked = P.marked(text)
    chunks = [tokens.Chunk(P, *c) for c in tokens.cut(marked, P.longest, size)]
    if not chunks:
        return
    states = tokens.edge_states([c.matrix() for c in chunks])
    parts = [c.ids(i, j) for c, i, j in zip(chunks, [0, *states[:-1]], states, strict=True)]
    assert np.concatenate(parts).tolist() == P.encode(text).tolist()


def test_texts_without_spaces_and_runs_of_spaces():
    rng = random.Random(3)
    texts = ["a" * 700, " " * 500 + "x", "x" + " " * 333 + "y z", "".join(rng.choice("0123456789") for _ in range(600))]
    texts += ["".join(rng.choice(["the", "ing", "中", "er", "q"]) for _ in range(300)) for _ in range(5)]
    for text in texts:
        assert P.encode(text).tolist() == LIBRARY.encode(text)
        marked = P.marked(text)
        chunks = [tokens.Chunk(P, *c) for c in tokens.cut(marked, P.longest, 100)]
        states = tokens.edge_states([c.matrix() for c in chunks])
        parts = [c.ids(i, j) for c, i, j in zip(chunks, [0, *states[:-1]], states, strict=True)]
        assert np.concatenate(parts).tolist() == LIBRARY.encode(text)


def test_scan_is_the_running_product():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 4, 2, 5, 3, 3]
    mats = [np.where(rng.random((a, b)) < 0.5, rng.integers(0, 9, (a, b)).astype(float), pieces.NONE) for a, b in zip(sizes, sizes[1:], strict=False)]
    now = mats[0]
    for got, m in zip(tokens.scan(mats)[1:], mats[1:], strict=True):
        now = tokens.times(now, m)
        assert (got == now).all()


def test_word_marks_survive():
    for text in ("▁", "a ▁b▁ c", " ▁", "▁▁ x"):
        assert P.decode(P.encode(text).tolist()) == text


@pytest.mark.parametrize("size", [tokens.CHUNK, 50])
def test_rows(spark, size):
    rng = random.Random(9)
    long_ = "".join(rng.choice([" word", " the", "中文", "\n", "aaaa", " é", "  "]) for _ in range(900))
    rows = [(1, long_), (1, long_), (2, None), (None, ""), (3, " a"), (4, "▁x"), (5, "short one"), (6, long_ + "!"), (7, "z" * 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    got = tokens.encode(spark, docs, size=size).withColumn("back", tokens.decode(F.col("ids"))).collect()
    assert sorted(((r.doc_id, r.text, r.ids) for r in got), key=str) == sorted(((i, t, P.encode(t or "").tolist()) for i, t in rows), key=str)
    assert all(r.back == (r.text or "") for r in got)
    assert tokens.encode(spark, docs.limit(0), size=size).count() == 0


def test_query_equals_the_library(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op2_sentencepiece(spark, sf).collect()
    assert len(found) == len(text) and all(r.round_trip for r in found)
    assert all(r.ids == LIBRARY.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in found)
