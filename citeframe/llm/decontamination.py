"""Benchmark decontamination with a distributed positional index.

Terms are runs of letters, digits and everything beyond ASCII, with A-Z lowered. Counting the benchmark's terms over the whole
corpus shows how rare each is; every window of an item is then searched from its rarest term only. The index stores where
those terms stand in the corpus: row, position and the nine terms to each side, which is what the offset-adjusted lists of
the other terms hold at that place. Intersecting them there gives the run of terms around the posting that the item has at
the same offsets; a run as long as the window is an exact match.

Edited copies are proximity matches. Each window is then searched from several of its rarest terms that the corpus has, so that
a term replaced hides none of the others; around every place the item's terms that stand near their offsets are marked, and
the marks of all places of about one shift are counted against all terms of the item.

Only terms that some window needs are stored. The terms looked up are broadcast, in blocks of at most ``BROADCAST`` bytes, so a
larger benchmark takes more passes and no larger broadcast; everything else that does not fit is joined by shuffles.

DataFrame functions only. Null texts have no terms. Rows are told apart by a number stored with the index, so repeated or
null ids keep rows of their own. A null item id marks documents but is no id to count; rows with one id are one item.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe.sources import scratch

N = 10
#: Terms of a window that edited copies are searched from.
SEVERAL = 3
#: Positions of a text that are searched from one copy of their surroundings.
STRETCH = 32
#: Positions of terms that one number marks.
_BITS = 62
#: Most bytes of terms, or of benchmark rows, that are broadcast.
BROADCAST = 16_000_000
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands behind the last term of a text; never a term.
_END = ""


def lowered(term: Column) -> Column:
    """A-Z lowered, nothing else; the fast function where a term is ASCII."""
    ascii_only = F.octet_length(term) == F.char_length(term)
    return F.when(ascii_only, F.lower(term)).otherwise(F.translate(term, string.ascii_uppercase, string.ascii_lowercase))


def terms(text: Column) -> Column:
    """Terms of a text in order, not yet lowered."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK, -1), "")


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, terms) of items that have any."""
    items = benchmark.select("item_id", F.transform(terms(F.col("text")), lowered).alias("terms"))
    return items.filter(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id())


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n) over all documents for the terms of ``vocabulary`` that occur."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    words = docs.select(F.explode(terms(F.col("text"))).alias("w")).select(lowered(F.col("w")).alias("term"))
    if size <= BROADCAST:
        return words.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term", "left_semi")


def _beside(words: Column, at: Column, size: Column) -> tuple[Column, Column]:
    """Up to nine terms before (nearest first) and after a position from 0."""
    before = F.reverse(F.slice(words, F.greatest(at - N + 2, F.lit(1)), F.least(at, F.lit(N - 1))))
    after = F.slice(words, F.least(at + 2, size + 1), F.lit(N - 1))
    return before, after


def _known(items: DataFrame, counts: DataFrame) -> DataFrame:
    spread = items.select("item", "item_id", "terms", F.posexplode("terms").alias("at", "term")).withColumn("length", F.size("terms"))
    return spread.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _places(windows: DataFrame) -> DataFrame:
    places = windows.select("item", "item_id", "length", "terms", F.col("r.term").alias("term"), F.col("r.at").alias("at")).distinct()
    before, after = _beside(F.col("terms"), F.col("at"), F.col("length"))
    return places.select("item", "item_id", "length", "term", "at", before.alias("before"), after.alias("after"))


def _ahead(value: Column) -> Column:
    return value.over(Window.partitionBy("item").orderBy("at").rowsBetween(0, N - 1))


def _starts() -> Column:
    return F.col("at") <= F.greatest(F.col("length") - N, F.lit(0))


def lookups(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, item, length, term, at, before, after): the rarest place of every window whose terms all may occur."""
    rarest = _known(items, counts).withColumn("r", _ahead(F.min(F.struct("n", "at", "term"))))
    return _places(rarest.filter(_starts() & (F.col("r.n") > 0)))


def near_lookups(items: DataFrame, counts: DataFrame, several: int = SEVERAL) -> DataFrame:
    """The same columns: the rarest places of every window among the terms that occur."""
    there = _ahead(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "at", "term"))))
    windows = _known(items, counts).withColumn("rarest", F.slice(F.array_sort(there), 1, several))
    return _places(windows.filter(_starts()).withColumn("r", F.explode("rarest")))


def store_index(spark: SparkSession, docs: DataFrame, vocabulary: DataFrame, path: str) -> DataFrame:
    """Writes and returns the postings of a vocabulary: (row, doc_id, term, pos, before, after), and for every document a row
    with the empty term whose position is the number of its terms."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = int(size // BROADCAST) + 1
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", terms(F.col("text")).alias("words"))
    ended = numbered.select("row", "doc_id", "words", F.posexplode(F.array_append("words", F.lit(_END))).alias("pos", "w"))
    found = ended.withColumn("term", lowered(F.col("w")))
    end = spark.range(1).select(F.lit(_END).alias("term"))
    for block in range(blocks):
        part = vocabulary.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        wanted = part.union(end) if block == 0 else part
        before, after = _beside(F.col("words"), F.col("pos"), F.size("words"))
        postings = found.join(F.broadcast(wanted), "term").select(
            "row", F.when(F.col("term") == _END, F.col("doc_id")).alias("doc_id"), "term", "pos",
            F.when(F.col("term") != _END, F.transform(before, lowered)).alias("before"),
            F.when(F.col("term") != _END, F.transform(after, lowered)).alias("after"),
        )
        postings.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _agree(one: Column, other: Column) -> Column:
    """Length of the common start of two arrays."""
    same = F.zip_with(one, other, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A broadcast hint where the rows are few enough."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST else df


def phrase_matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, item, item_id, low, high): runs of a document's terms that an item has too, a whole window at least."""
    of_item = wanted.select("term", "item", "item_id", "length", F.col("before").alias("i_before"), F.col("after").alias("i_after"))
    size = F.octet_length("term") + F.octet_length(F.array_join("i_before", "")) + F.octet_length(F.array_join("i_after", "")) + 400
    joined = index.filter(F.col("term") != _END).join(_small(of_item, size), "term")
    left, right = _agree(F.col("before"), F.col("i_before")), _agree(F.col("after"), F.col("i_after"))
    runs = joined.select("row", "item", "item_id", "length", "pos", left.alias("left"), right.alias("right"))
    whole = F.col("left") + F.col("right") + 1 >= F.least("length", F.lit(N))
    return runs.filter(whole).select(
        "row", "item", "item_id", (F.col("pos") - F.col("left")).alias("low"), (F.col("pos") + F.col("right")).alias("high")
    )


def _near(terms_: Column, beside: Column, slack: int, place) -> Column:
    """Places of the item's terms on one side that the text has there too, shifted by up to ``slack``."""

    def found(term: Column, k: Column) -> Column:
        first = F.greatest(k + 1 - slack, F.lit(1))
        return F.when(F.array_contains(F.slice(beside, first, k + 2 + slack - first), term), place(k))

    return F.filter(F.transform(terms_, found), lambda at: at.isNotNull())


def proximity_matches(index: DataFrame, wanted: DataFrame, slack: int = 5, share: float = 0.8) -> DataFrame:
    """(row, item, item_id, low, high, n, length): places where at least ``share`` of all terms of an item stand near the
    item's offsets, whatever stands between them; ``n`` of its ``length`` terms do. Terms shifted against each other by up to
    ``slack`` positions are always found together, beyond twice the slack never: shifts are put into bins, laid twice, half a
    bin apart. A term alone, without any other of the item near it, counts for items of one term only."""
    of_item = wanted.select("term", "item", "item_id", "at", "length", F.col("before").alias("i_before"), F.col("after").alias("i_after"))
    size = F.octet_length("term") + F.octet_length(F.array_join("i_before", "")) + F.octet_length(F.array_join("i_after", "")) + 400
    joined = index.filter(F.col("term") != _END).join(_small(of_item, size), "term")
    before = _near(F.col("i_before"), F.col("before"), slack, lambda k: F.col("at") - k - 1)
    after = _near(F.col("i_after"), F.col("after"), slack, lambda k: F.col("at") + k + 1)
    agreed = joined.withColumn("agreed", F.concat(F.array("at"), before, after))
    agreed = agreed.filter(F.size("agreed") >= F.least("length", F.lit(2)))

    def marks(block: Column) -> Column:
        of_block = F.filter("agreed", lambda at: F.floor(at / _BITS) == block)
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % _BITS).cast("int"))
        return F.struct(block.alias("block"), F.aggregate(of_block, F.lit(0).cast("bigint"), lambda m, at: m.bitwiseOR(bit(at))).alias("mask"))

    blocks = F.transform(F.array_distinct(F.transform("agreed", lambda at: F.floor(at / _BITS))), marks)
    shift, width = F.col("pos") - F.col("at"), 2 * slack + 1
    bins = F.array(F.floor(shift / width) * 2, F.floor((shift + slack) / width) * 2 + 1)
    marked = agreed.select("row", "item", "item_id", "length", "pos", F.explode(blocks).alias("m"), bins.alias("bins"))
    marked = marked.select("row", "item", "item_id", "length", "pos", "m.block", "m.mask", F.explode("bins").alias("bin"))
    of_block = marked.groupBy("row", "item", "bin", "block").agg(
        F.first("item_id").alias("item_id"), F.first("length").alias("length"), F.bit_count(F.bit_or("mask")).alias("n"),
        F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    grouped = of_block.groupBy("row", "item", "bin").agg(
        F.first("item_id").alias("item_id"), F.first("length").alias("length"), F.sum("n").cast("int").alias("n"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    near = grouped.filter(F.col("n") >= F.col("length") * share)
    return near.select("row", "item", "item_id", "low", "high", "n", "length").distinct()


def _stretches(docs: DataFrame) -> DataFrame:
    """(row, start, first, near): texts cut at every ``STRETCH`` positions, with the neighbours of the outer ones, so that
    what a position carries does not grow with its text. ``start`` is the position of the first term of ``near``."""
    row = F.struct(F.monotonically_increasing_id().alias("number"), "doc_id").alias("row")
    words = docs.select(row, terms(F.col("text")).alias("words")).filter(F.size("words") > 0)

    def stretch(first: Column) -> Column:
        start = F.greatest(first - (N - 1), F.lit(0))
        near = F.slice(F.col("words"), start + 1, first + STRETCH + N - 1 - start)
        return F.struct(start.alias("start"), first.alias("first"), near.alias("near"))

    firsts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRETCH))
    cut = words.select("row", F.explode(F.transform(firsts, stretch)).alias("s"))
    return cut.select("row", "s.start", "s.first", F.transform("s.near", lowered).alias("near"))


def proximity(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(row, doc_id, item, item_id, low, high, n, length) of every document and item that match nearly: where most of the
    item's terms do, then the first. Places are not stored: each block of terms is read from the documents."""
    items = benchmark_terms(benchmark)
    path = scratch.new_path(spark, "near-lookups")
    near_lookups(items, term_counts(docs, items.select(F.explode("terms").alias("term")).distinct())).write.parquet(path)
    wanted = spark.read.parquet(path)
    vocabulary = wanted.select("term").distinct()
    spread = _stretches(docs).select("row", "start", "first", "near", F.posexplode("near").alias("at", "term"))
    pos = F.col("start") + F.col("at")
    found = spread.filter((pos >= F.col("first")) & (pos < F.col("first") + STRETCH))
    size = vocabulary.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = int(size // BROADCAST) + 1
    before, after = _beside(F.col("near"), F.col("at"), F.size("near"))
    postings = None
    for block in range(blocks):
        part = found.join(F.broadcast(vocabulary.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)), "term", "left_semi")
        part = part.select("row", "term", pos.alias("pos"), before.alias("before"), after.alias("after"))
        postings = part if postings is None else postings.union(part)
    near = proximity_matches(postings, wanted, **options)
    best = F.min(F.struct((-F.col("n")).alias("least"), "low", "high", "n", "length", "item_id")).alias("best")
    return near.groupBy("row", "item").agg(best).select(
        "row.number", "row.doc_id", "item", "best.item_id", "best.low", "best.high", "best.n", "best.length"
    ).withColumnRenamed("number", "row")


def build(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored index of a corpus for a benchmark, and the places to look up."""
    items = benchmark_terms(benchmark)
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    path = scratch.new_path(spark, "lookups")
    lookups(items, term_counts(docs, vocabulary)).write.parquet(path)
    wanted = spark.read.parquet(path)
    return store_index(spark, docs, wanted.select("term").distinct(), scratch.new_path(spark, "postings")), wanted


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, hits, items) of every document: hit runs of term positions (inclusive, not merged) and ids of
    the items with a window in it."""
    index, wanted = build(spark, docs, benchmark)
    ends = index.filter(F.col("term") == _END).select(
        "row", "doc_id", F.col("pos").alias("n_words"), F.lit(None).cast("struct<low: int, high: int>").alias("hit"),
        F.lit(None).cast(wanted.schema["item_id"].dataType).alias("item_id"),
    )
    found = phrase_matches(index, wanted).select(
        "row", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("int").alias("n_words"),
        F.struct("low", "high").alias("hit"), "item_id",
    )
    return ends.union(found).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"),
        F.collect_set("item_id").alias("items"),
    )


def n_covered(hits: Column) -> Column:
    """Positions that runs (low, high) cover."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end"))

    def step(total: Column, run: Column) -> Column:
        new = F.greatest(F.lit(0), run["high"] - F.greatest(total["end"], run["low"] - 1))
        return F.struct((total["n"] + new).alias("n"), F.greatest(total["end"], run["high"]).alias("end"))

    return F.aggregate(F.array_sort(hits), start, step, lambda total: total["n"])
