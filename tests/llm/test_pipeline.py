"""The pipeline against its stages by brute force, each judged on what the stage before it kept."""

from collections import Counter

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F
from test_decontamination import plain as hits_of
from test_simhash import plain_components, plain_fingerprint

from citeframe.llm import quality, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(texts, width=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_same_rows_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL_FILE)

    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = docs.select("doc_id", quality.score(F.col("text"), model).alias("p")).collect()
    good = {r.doc_id for r in scores if r.p >= 0.3}
    kept = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    assert 0 < len(kept) < docs.count()

    ids = [i for i, _ in kept]
    groups = plain_components([plain_fingerprint(t) for _, t in kept], ids)
    single = [(i, t) for (i, t), g in zip(kept, groups, strict=True) if i == g]
    assert len(single) < len(kept)

    cut = list(zip([i for i, _ in single], without_repeats([t for _, t in single]), strict=True))
    assert any(a != b for (_, a), (_, b) in zip(single, cut, strict=True))

    clean = {row[0] for row in hits_of(cut, items) if row[2] == 0}
    assert len(clean) < len(cut)
    want = [(i, t, library.encode(t), len(t)) for i, t in cut if i in clean]

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*COLUMNS, "ids"]
    assert sorted((r.doc_id, r.text, list(r.ids), r.n_chars) for r in out.collect()) == want


def test_stages_with_odd_rows_and_no_rows(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, kept int"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [
        (1, "same words here", None, None, 15, "k", 1), (1, "same words here", None, None, 15, "k", 1), (None, None, None, None, None, None, None),
        (None, f"so it says: {passage}", "en", "s", 1, "k", 2), (None, "nothing of that kind stands here at all", "en", "s", 1, "k", 3),
        (2, "", "", "", 0, "", 0), (3, "long " * 30000, "en", "s", 150000, "k", 4),
    ]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    left = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == left[name].columns and empty.count() == 0
    assert {r.text for r in left["benchmark_decontamination"].collect()} == {r[1] for r in rows if passage not in (r[1] or "")}
    singles = [(r.doc_id, r.text) for r in left["simhash_near_dedup"].collect()]
    assert singles.count((1, "same words here")) == 1 and len(singles) == 5
    assert left["sentencepiece"].count() == 7
    assert left["suffix_array_dedup"].select("doc_id").count() == 7
