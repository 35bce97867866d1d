"""Exact removal of repeated byte strings with a sparse suffix array.

A byte goes when a string of ``WINDOW`` bytes covers it that also starts anywhere else in the corpus. Sorting a suffix for
every byte would move the corpus many times over, so suffixes are taken at anchors only: in every window, the position whose
``GRAM`` bytes hash least. The choice depends on the window's bytes alone, so equal windows have their anchor at the same
place. All consecutive windows with one anchor form a span.

1. Anchors sampled from some texts give splitters; suffixes are range-partitioned by their leading bytes, so equal ones share a
   bucket. Buckets are sorted and neighbours compared, also across the batches a bucket is read in. Spans found twice are
   repeated as a whole. Single spans whose anchor also occurs in another span are left open; all others are unique.
2. The texts of open spans are fetched. Their suffixes, one for every window, are sorted by multikey quicksort, eight bytes
   at a time, and only ties go on to the next eight; what is tied after ``WINDOW`` bytes is repeated. The end of a window that
   lies further from its anchor is compared first. An anchor in more than ``CROWD`` open spans is not sorted in one
   task: its windows are grouped by digest instead, spread over all tasks.
3. Repeated windows are joined to the texts as intervals and cut out.

Map tasks send one row for each span however often they see it, so crowds of copies stay small. Everything is keyed by the
text's digest: equal texts get equal results, whatever their ids. Null texts count as empty. Digests have 128 bits; extra
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm.arrow_runs import runs, small
from citeframe.sources import scratch

WINDOW = 200
GRAM = 80
#: Texts that splitters are sampled from, and anchors kept of them.
SAMPLE_TEXTS = 2000
SAMPLE_ANCHORS = 100_000
#: Buckets for each shuffle partition.
BUCKETS = 16
#: Most open spans with one anchor that are sorted together.
CROWD = 20_000
#: Windows that are anchored at a time; windows and bytes of spans above which no further anchor joins a sort.
PIECE = 1 << 16
SORTED = 1 << 18
SORTED_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_POSITION = 17  # bits; positions in a piece and its tail are below 2^17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, PIECE + WINDOW + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), PIECE + WINDOW + 1)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


# Anchors


def _least_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the bytes from every position, and for every window the position of its least hash, the first of equals."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _UP[:n], out=sums[1:])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    low = np.uint64((1 << _POSITION) - 1)
    least, width, full = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1, WINDOW - GRAM + 1
    while 2 * width <= full:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < full:
        least = np.minimum(least[: len(least) - (full - width)], least[full - width :])
    return hashes, (least & low).astype(np.int64)


def spans(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans of texts laid end to end: anchor hash, anchor position, first window, windows, text number.

    ends: start of the first text, then the end of each."""
    first, last = int(ends[0]), int(ends[-1]) - WINDOW + 1
    for start in range(first, last, PIECE):
        stop = min(start + PIECE, last)
        hashes, at = _least_grams(data[start : stop + WINDOW - 1])
        windows = np.arange(start, stop)
        text = np.searchsorted(ends, windows, "right") - 1
        at[ends[text + 1] - windows < WINDOW] = -1
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(text) != 0)) + 1
        a = np.concatenate([[0], cut])
        n = np.diff(np.concatenate([a, [len(at)]]))
        here = at[a] >= 0
        a, n = a[here], n[here]
        yield hashes[at[a]].view(np.int64), start + at[a], start + a, n, text[a]


def _laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ends of its texts."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leading 16 bytes of suffixes, comparable."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(16)]).view("S16")[:, 0]


def splitters(docs: DataFrame, n: int) -> list[bytes]:
    """Bounds of ``n`` buckets with about equally many suffixes, from a bounded sample of texts."""
    rate = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    slots = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 20))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _laid_out(batch.column("text"))
            for _, at, *_ in spans(data, ends):
                yield pa.RecordBatch.from_arrays([pa.array(_leads(data, at).tolist(), pa.binary())], ["lead"])

    sampled = docs.filter(slots < int(rate * (1 << 20)) + 1).limit(2 * SAMPLE_TEXTS).mapInArrow(leads, "lead binary")
    found = np.sort(np.array([bytes(r[0]) for r in sampled.limit(SAMPLE_ANCHORS).collect()], "S16"))
    if not len(found):
        return []
    return np.unique(found[(np.arange(1, n) * len(found)) // n]).tolist()


_SUFFIX = "bucket int, gram bigint, s1 bigint, s2 bigint, weight tinyint, key binary, a bigint, off int, n int"
_STATUS = "open boolean, bucket int, gram bigint, s1 bigint, s2 bigint, single boolean, key binary, a bigint, off int, n int"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _anchored(bounds: list[bytes]):
    """Suffix rows of a task: one for each span a batch holds. What a batch holds twice is known to be repeated, and its
    places are sent along as rows of weight 0."""
    limits = np.array(bounds, "S16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            keys = batch.column("key").to_pylist()
            first: dict[bytes, int] = {}
            copies: dict[bytes, int] = {}
            for i, k in enumerate(keys):
                first.setdefault(k, i)
                copies[k] = copies.get(k, 0) + 1
            texts = batch.column("text").take(pa.array(list(first.values()), pa.int64()))
            names = np.array(list(first), dtype=object)
            twice = np.array([copies[k] > 1 for k in first], dtype=bool)
            if not len(names):
                continue
            data, ends = _laid_out(texts)
            parts = list(spans(data, ends))
            if not parts:
                continue
            gram, at, a, n, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(gram):
                continue
            view = memoryview(data)
            digest = xxhash.xxh3_128_digest
            joined = b"".join(
                [digest(view[x:y]) for x, y in zip(a.tolist(), (a + n + WINDOW - 1).tolist(), strict=True)]
            )
            s = np.frombuffer(joined, np.int64).reshape(-1, 2)
            order = np.lexsort((s[:, 1], s[:, 0]))
            same = (s[order][1:] == s[order][:-1]).all(axis=1)
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            count = np.diff(np.concatenate([start, [len(order)]]))
            inside = a - ends[text]
            bucket = np.searchsorted(limits, _leads(data, at), "right")
            repeated = np.maximum.reduceat(twice[text][order], start) | (count > 1)
            rep = order[start]
            yield _batch(
                _SUFFIX, bucket[rep].astype(np.int32), gram[rep], s[rep, 0], s[rep, 1],
                np.where(repeated, 2, 1).astype(np.int8), pa.array(names[text[rep]].tolist(), pa.binary()), inside[rep],
                (at - a)[rep].astype(np.int32), n[rep].astype(np.int32),
            )
            known = order[np.repeat(repeated, count)]
            yield _batch(
                _SUFFIX, (_spread(gram[known], inside[known]) % (len(limits) + 1)).astype(np.int32), gram[known], s[known, 0],
                s[known, 1], np.zeros(len(known), np.int8), pa.array(names[text[known]].tolist(), pa.binary()), inside[known],
                np.zeros(len(known), np.int32), n[known].astype(np.int32),
            )

    return run


def _spread(gram: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = (gram.view(np.uint64) + place.astype(np.uint64)) * np.uint64(_BASE)
    return (x >> np.uint64(33)).astype(np.int64)


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads a bucket in order. Only the last span of a batch is held until its end is known."""
    held: pa.Table | None = None
    before = None  # anchor of the span before the held one

    def decide(rows: pa.Table, before, after) -> pa.RecordBatch:
        col = {c: rows[c].to_numpy() for c in ("gram", "s1", "s2", "weight")}
        new = np.concatenate([[True], (np.diff(col["s1"]) != 0) | (np.diff(col["s2"]) != 0) | (np.diff(col["gram"]) != 0)])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(new)]]))
        repeated = np.add.reduceat(col["weight"].astype(np.int64), start) > 1
        gram = col["gram"][start]
        known = [before is not None and gram[0] == before], gram[1:] == gram[:-1], [after is not None and gram[-1] == after]
        shared = np.concatenate(known[:2]) | np.concatenate(known[1:])
        opened = start[shared]
        covered = np.flatnonzero(np.repeat(repeated, size) & (col["weight"] == 1))
        picked = np.concatenate([opened, covered])
        table = rows.take(pa.array(picked))
        flags = np.concatenate([np.ones(len(opened), bool), np.zeros(len(covered), bool)])
        single = np.concatenate([~repeated[shared], np.zeros(len(covered), bool)])
        table = table.drop_columns(["weight"]).append_column("open", pa.array(flags)).append_column("single", pa.array(single))
        return table.select([c.split()[0] for c in _STATUS.split(", ")]).combine_chunks()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        passed = table.filter(pa.array(table["weight"].to_numpy() == 0))
        if passed.num_rows:
            n = passed.num_rows
            passed = passed.drop_columns(["weight"]).append_column("open", pa.array(np.zeros(n, bool)))
            passed = passed.append_column("single", pa.array(np.zeros(n, bool)))
            yield from passed.select([c.split()[0] for c in _STATUS.split(", ")]).to_batches()
        table = table.filter(pa.array(table["weight"].to_numpy() != 0))
        if not table.num_rows:
            continue
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        ids = np.stack([table[c].to_numpy() for c in ("gram", "s1", "s2")])
        change = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield from decide(table.slice(0, last), before, ids[0, last]).to_batches()
            before = ids[0, last - 1]
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield from decide(held, before, None).to_batches()


# Open spans

_OPEN = "crowded boolean, bucket int, gram bigint, single boolean, key binary, a bigint, off int, n int, span binary, w1 bigint, w2 bigint"


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of open spans; for crowded anchors a digest of every window. A text is read once in a task."""
    seen: set[bytes] = set()
    digest = xxhash.xxh3_128_digest
    for batch in small(batches, "text", 2_000_000):
        out: list[tuple] = []
        for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("open").to_pylist(), strict=True):
            if key in seen:
                continue
            seen.add(key)
            raw = memoryview(text.as_buffer())
            for w in wanted:
                a, n = w["a"], w["n"]
                row = (w["crowded"], w["bucket"], w["gram"], w["single"], key)
                if not w["crowded"]:
                    out.append((*row, a, w["off"], n, bytes(raw[a : a + n + WINDOW - 1]), None, None))
                    continue
                for x in range(a, a + n):
                    pair = np.frombuffer(digest(raw[x : x + WINDOW]), np.int64)
                    out.append((*row, x, w["off"] - (x - a), 1, None, int(pair[0]), int(pair[1])))
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


_OPEN_TYPES = pa.schema([
    ("crowded", pa.bool_()), ("bucket", pa.int32()), ("gram", pa.int64()), ("single", pa.bool_()), ("key", pa.binary()),
    ("a", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("span", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64()),
])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OPEN_TYPES, strict=True)], schema=_OPEN_TYPES
    )


def tied_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Numbers of the windows that another window of their group equals, by multikey quicksort: sorted by one word of
    eight bytes, from the front or from the back; what is alone with its words so far drops out."""
    # WINDOW is a multiple of eight, so a word never reaches past its window.
    eights = np.lib.stride_tricks.sliding_window_view(data, 8) if len(start) else data
    left = np.arange(len(start))
    tie = group
    for level in range(0, WINDOW, 8):
        word = eights[start[left] + np.where(forward[left], level, WINDOW - 8 - level)].view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((word, tie))
        left, word, tie = left[order], word[order], tie[order]
        new = np.concatenate([[True], (np.diff(tie) != 0) | (word[1:] != word[:-1])])
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        left, tie = left[keep], number[keep]
        if not len(left):
            break
    return left


def _sort_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of single spans, run by run; whole anchors are gathered until there are enough windows."""
    gathered: list[pa.Table] = []
    windows = size = 0
    for _, table in runs(batches, "gram"):
        if table.num_rows < 2:
            continue
        gathered.append(table)
        windows += int(table["n"].to_numpy().sum())
        size += int(table["n"].to_numpy().sum()) + (WINDOW - 1) * table.num_rows
        if windows >= SORTED or size >= SORTED_BYTES:
            yield _sorted_runs(gathered)
            gathered, windows, size = [], 0, 0
    if gathered:
        yield _sorted_runs(gathered)


def _sorted_runs(tables: list[pa.Table]) -> pa.RecordBatch:
    anchor = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
    table = pa.concat_tables(tables).combine_chunks()
    data, ends = _laid_out(table["span"].combine_chunks() if table["span"].num_chunks != 1 else table["span"].chunk(0))
    n, off = table["n"].to_numpy().astype(np.int64), table["off"].to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    before = off[row] - step  # bytes of the window that stand before its anchor
    tied = tied_windows(data, ends[:-1][row] + step, anchor[row] * WINDOW + before, before >= (WINDOW - GRAM) // 2)
    tied = np.sort(tied[table["single"].to_numpy(zero_copy_only=False)[row[tied]]])
    new = np.flatnonzero(np.concatenate([[True], (np.diff(tied) != 1) | (np.diff(row[tied]) != 0)])) if len(tied) else tied
    length = np.diff(np.concatenate([new, [len(tied)]]))
    first = tied[new]
    keys = table["key"].take(pa.array(row[first])).combine_chunks()
    keys = keys if isinstance(keys, pa.Array) else pa.concat_arrays(keys.chunks) if keys.num_chunks else pa.array([], pa.binary())
    a = table["a"].to_numpy()[row[first]] + step[first]
    return pa.RecordBatch.from_arrays([keys, pa.array(a), pa.array(length.astype(np.int32))], ["key", "a", "n"])


def repeated_windows(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, a, n): runs of ``n`` windows from byte ``a`` of a text that start elsewhere too. Runs may overlap."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text_key(F.col(text_col)).alias("key"), text.alias("text")).filter(F.octet_length("text") >= WINDOW)
    n_buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = texts.mapInArrow(_anchored(splitters(texts, n_buckets)), _SUFFIX)
    buckets = suffixes.repartition("bucket").sortWithinPartitions("gram", "s1", "s2")
    first = scratch.new_path(spark, "spans")
    buckets.mapInArrow(_compare_neighbours, _STATUS).write.parquet(first)
    status = spark.read.schema(_STATUS).parquet(first)

    opened = status.filter("open").drop("open")
    crowds = opened.groupBy("gram").count().filter(F.col("count") > CROWD).select("gram", F.lit(True).alias("crowded"))
    opened = opened.join(crowds, "gram", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = opened.groupBy("key").agg(F.collect_list(F.struct("crowded", "bucket", "gram", "single", "a", "off", "n")).alias("open"))
    second = scratch.new_path(spark, "open-spans")
    texts.join(wanted, "key").mapInArrow(_fetched, _OPEN).write.parquet(second)
    fetched = spark.read.schema(_OPEN).parquet(second)

    spans_ = fetched.filter(~F.col("crowded")).select("bucket", "gram", "single", "key", "a", "off", "n", "span")
    sorted_ = spans_.repartition("bucket", "gram").sortWithinPartitions("gram").mapInArrow(_sort_open, "key binary, a bigint, n int")
    loose = fetched.filter("crowded").dropDuplicates(["key", "a", "gram"])
    often = loose.groupBy("w1", "w2").count().filter("count > 1")
    crowded = loose.filter("single").join(often, ["w1", "w2"], "left_semi").select("key", "a", "n")
    return status.filter(~F.col("open")).select("key", "a", "n").union(sorted_).union(crowded)


def merged(start: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    order = np.argsort(start, kind="stable")
    out: list[tuple[int, int]] = []
    for a, e in zip(start[order].tolist(), (start + windows + WINDOW - 1)[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``removed`` (maximal runs of bytes, as start and end) and ``kept`` (all other bytes)."""
    covered = repeated_windows(spark, docs, text_col).groupBy("key").agg(
        F.collect_list("a").alias("r_a"), F.collect_list("n").alias("r_n")
    ).withColumnRenamed("key", "r_key_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "r_text"):
            removed, kept = [], []
            texts, starts, windows = (batch.column(c) for c in ("r_text", "r_a", "r_n"))
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                if not starts[i].is_valid:
                    removed.append([])
                    kept.append(raw.to_pybytes())
                    continue
                gone = merged(starts[i].values.to_numpy(), windows[i].values.to_numpy().astype(np.int64))
                view = memoryview(raw)
                edges = [0, *(x for run in gone for x in run), len(view)]
                removed.append([{"start": a, "end": e} for a, e in gone])
                kept.append(b"".join(view[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind), pa.array(kept, pa.binary())], [*carried, "removed", "kept"])

    carried = [c for c in docs.columns if c not in (text_col, "removed", "kept")]
    rows = docs.select(
        *carried, F.coalesce(F.col(text_col), F.lit("")).alias("r_text"), text_key(F.col(text_col)).alias("r_digest_")
    ).join(covered, F.col("r_digest_") == F.col("r_key_"), "left")
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in carried)
    schema = ", ".join(x for x in (fields, "removed array<struct<start: bigint, end: bigint>>, kept binary") if x)
    return rows.select(*carried, "r_text", "r_a", "r_n").mapInArrow(cut, schema)
