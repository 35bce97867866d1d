"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

Encoding is a best path over pieces (see ``pieces``): 0 for compatible neighbours, minus infinity for others. A document of
more than ``CHUNK`` characters is split into chunks that are worked on separately:

1. Every chunk finds the pieces that can reach over its left and right edge and gives a matrix: entry (i, j) is 0 where a
   compatible path leads from piece i over the left edge to piece j over the right edge.
2. Matrices multiply in max-plus algebra, which is associative; a scan over pairs gives the best path up to every edge, and
   following it back picks the piece over each edge.
3. With both edges known, chunks trace their pieces on their own; the parts are put together in order.

Up to that length a document is its own single chunk. Ids equal those of the SentencePiece library, but for the word mark
U+2581 in a text: here it is written as bytes and survives decoding. Null texts have no tokens, as empty ones. Chunks are keyed by
the text's digest, so ids and repeated rows do not matter. The vocabulary file's path is a parameter; the file has to exist
where tasks run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm.arrow_runs import small
from citeframe.llm.pieces import MARK, NONE, Pieces, load
from citeframe.llm.suffixes import text_key
from citeframe.sources import scratch

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
#: Bytes of text that a task encodes at a time.
PIECE = 2_000_000

# Max-plus


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all matrices up to each place, from products of pairs."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = scan([times(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    return [
        matrices[0] if i == 0 else pairs[i // 2] if i % 2 else times(pairs[i // 2 - 1], matrices[i]) for i in range(len(matrices))
    ]


def edge_states(matrices: list[np.ndarray]) -> list[int]:
    """State at the right edge of every chunk on the best path."""
    upto = scan(matrices)
    out = [int(np.argmax(upto[-1][0]))]
    for i in range(len(matrices) - 1, 0, -1):
        out.append(int(np.argmax(upto[i - 1][0] + matrices[i][:, out[-1]])))
    return out[::-1]


# Chunks


def cut(marked: str, longest: int, size: int) -> Iterator[tuple[str, int, int]]:
    """Chunks as (text with what stands around it, left edge, right edge). Edges stay away from word marks, since the merging
    of a run of marks depends on all of it."""
    start, n = 0, len(marked)
    while start < n:
        end = min(start + size, n)
        while end < n and MARK in (marked[end], marked[end - 1]):
            end += 1
        low = max(0, start - longest)
        yield marked[low : min(n, end + longest)], start - low, end - low
        start = end


class Chunk:
    """A stretch of a marked text between two edges, with the pieces that may reach over them."""

    def __init__(self, pieces: Pieces, text: str, left: int, right: int):
        self.p, self.text, self.left, self.right = pieces, text, left, right
        self.starts = [(0, 0)] if left == 0 else self._over(left)
        self.ends = self._over(right)
        cuts = [q for q in self._cuts(left, right)]
        self.cuts = cuts
        if cuts:
            self.tail = pieces.last_pieces(text, cuts[-1], self._reach())

    def _reach(self) -> int:
        return min(len(self.text), self.right + self.p.longest)

    def _over(self, edge: int) -> list[tuple[int, int]]:
        """Spans of pieces that begin before an edge and end at it or behind it."""
        text, longest = self.text, self.p.longest
        if text[edge - 1] == MARK:  # the end of a text that ends in marks
            x = len(text[:edge].rstrip(MARK))
            return [(x, edge)]
        found = []
        for x in range(max(0, edge - longest), edge):
            for y in range(edge, min(len(text), x + longest) + 1):
                if y == x + 1 or text[x:y] in self.p.ids and text[x + 1] != MARK:
                    found.append((x, y))
        return found

    def _cuts(self, start: int, end: int) -> list[int]:
        """First and last place where a word begins."""
        text = self.text
        places = []
        q = text.find(MARK, max(start, 1))
        while q != -1 and q <= end:
            if text[q - 1] != MARK:
                places.append(q)
                break
            q = text.find(MARK, q + 1)
        q = text.rfind(MARK, max(start, 1), end + 1)
        while q != -1 and places:
            if text[q - 1] != MARK:
                places.append(q)
                break
            q = text.rfind(MARK, max(start, 1), q)
        return places

    def _first_cut(self, after: int) -> int | None:
        if not self.cuts or self.cuts[-1] < after:
            return None
        if self.cuts[0] >= after:
            return self.cuts[0]
        found = self._cuts(after, self.right)
        return found[0] if found else None

    def _from(self, state: tuple[int, int], to: int) -> dict[int, str]:
        x, y = state
        return self.p.last_pieces(self.text, y, to, self.text[x:y] or None)

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.starts), len(self.ends)), NONE)
        for i, (x, y) in enumerate(self.starts):
            if y >= self.right and x < y:
                out[i, self.ends.index((x, y))] = 0
                continue
            q = self._first_cut(y)
            if q is None:
                last = self._from((x, y), self._reach())
            elif q in self._from((x, y), q):
                last = self.tail
            else:
                continue
            for j, (a, b) in enumerate(self.ends):
                before = last.get(a)
                if a in last and (before is None or self.p.compatible(before, self.text[a:b])):
                    out[i, j] = 0
        return out

    def ids(self, i: int, j: int) -> np.ndarray:
        """Ids of the pieces that begin between the edges."""
        (x, y), (a, b) = self.starts[i], self.ends[j]
        if y >= self.right and x < y:
            return np.zeros(0, np.int32)
        p, text = self.p, self.text
        q = self._first_cut(y)
        if q is None:
            found = p.traced(self._from((x, y), a), y, a)
            middle = b""
            tail: list[str] = []
        else:
            found = p.traced(self._from((x, y), q), y, q)
            middle = b"".join(map(p.unit_ids, p.units(text[q : self.cuts[-1]])))
            tail = p.traced(self.tail, self.cuts[-1], a)
        head = np.array([t for s in found for t in p.token_ids(s)], np.int32)
        rest = np.array([t for s in [*tail, text[a:b]] for t in p.token_ids(s)], np.int32)
        return np.concatenate([head, np.frombuffer(middle, np.int32), rest])


# Spark


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))


_CHUNKS = "key binary, chunk int, body binary, low int, high int"


def _text(body: bytes) -> str:
    return body.decode("utf-8", "surrogatepass")


def _encode_giants(spark: SparkSession, giants: DataFrame, model_file: str, size: int) -> DataFrame:
    """(key, ids) of distinct long texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = load(model_file).longest
        for batch in small(batches, "text", PIECE):
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                for n, (body, low, high) in enumerate(cut(Pieces.marked(text.as_py()), longest, size)):
                    row = (key.as_py(),), (n,), (body.encode("utf-8", "surrogatepass"),), (low,), (high,)
                    kinds = pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["key", "chunk", "body", "low", "high"]
                    )

    def chunks_of(batch: pa.RecordBatch, pieces: Pieces) -> Iterator[Chunk]:
        for body, low, high in zip(*(batch.column(c) for c in ("body", "low", "high")), strict=True):
            yield Chunk(pieces, _text(body.as_py()), low.as_py(), high.as_py())

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in small(batches, "body", PIECE):
            found = [c.matrix() for c in chunks_of(batch, pieces)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("chunk"), pa.array([m.shape[1] for m in found], pa.int32()),
                    pa.array([(m == 0).astype(np.uint8).tobytes() for m in found], pa.binary()),
                ],
                ["key", "chunk", "wide", "open"],
            )

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        found = [
            np.where(np.frombuffer(r.open, np.uint8).reshape(-1, r.wide) == 1, 0.0, NONE) for r in rows.itertuples()
        ]
        right = edge_states(found)
        return pd.DataFrame({"key": rows["key"], "chunk": rows["chunk"], "i": [0, *right[:-1]], "j": right})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in small(batches, "body", PIECE):
            states = zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)
            found = [c.ids(i, j) for c, (i, j) in zip(chunks_of(batch, pieces), states, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), _lists(found)], ["key", "chunk", "ids"])

    distinct = giants.dropDuplicates(["key"]).mapInArrow(split, _CHUNKS)
    path = scratch.new_path(spark, "chunks")
    distinct.repartition("key", "chunk").write.parquet(path)
    chunks = spark.read.schema(_CHUNKS).parquet(path)
    edges = chunks.mapInArrow(matrices, "key binary, chunk int, wide int, open binary")
    states = edges.groupBy("key").applyInPandas(combine, "key binary, chunk int, i int, j int")
    parts = chunks.join(states, ["key", "chunk"]).mapInArrow(trace, "key binary, chunk int, ids array<int>")
    ordered = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("p"))
    return ordered.select("key", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def encode(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", model_file: str = MODEL_FILE, size: int = CHUNK,
    verify: bool = False,
) -> DataFrame:
    """The documents with ``ids``, the token ids of the whole text, and with ``verify`` also ``round_trip``: whether they
    decode to that text. Short texts are decoded where they are encoded."""
    added = ["ids", "round_trip"] if verify else ["ids"]
    kept = [c for c in docs.columns if c not in added]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    length = F.coalesce(F.char_length(text_col), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in small(batches, text_col, PIECE):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = [pieces.encode(t) for t in texts]
            columns = [*batch.columns, _lists(found)]
            if verify:
                columns.append(pa.array([pieces.decode(f.tolist()) == t for f, t in zip(found, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    types = f"{fields}, ids array<int>" + (", round_trip boolean" if verify else "")
    whole = docs.select(*kept).filter(length <= size).mapInArrow(short, types)
    long_ = docs.select(*kept, text_key(F.col(text_col)).alias("t_digest_")).filter(length > size)
    giants = long_.select(F.col("t_digest_").alias("key"), F.col(text_col).alias("text"))
    found = _encode_giants(spark, giants, model_file, size).withColumnRenamed("key", "t_key_")
    joined = long_.join(found, F.col("t_digest_") == F.col("t_key_")).select(*kept, "ids")
    if verify:
        joined = joined.withColumn("round_trip", decode(F.col("ids"), model_file) == F.col(text_col))
    return whole.unionByName(joined)


def decode(ids: Column, model_file: str = MODEL_FILE) -> Column:
    """Text of token ids."""

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        pieces = load(model_file)
        return pd.Series([None if r is None else pieces.decode(r.tolist()) for r in rows], dtype=object)

    return texts(ids)
