"""Conversation repair by weighted interval parsing.

Rows of a conversation are parsed bottom-up with a grammar in Chomsky normal form. Its nonterminals are pairs of states of the role
order ``(s?(ua)+)?``: ``N(p,q) -> N(p,r) N(r,q)``, with terminals for the edits of a row (keep, rerole, delete). Every cell of a
span holds, for each nonterminal, the least (cost, audit), where the audit lists the edits' initials; the insertion closure, runs of
inserted turns that lead from one state to another, stands around every terminal. A pair-of-states grammar gives the same cell for
every split of a span, so spans are combined by doubling length, one split each. No equal-cost audit of a span is the beginning
of another (more inserts cost more), so least audits stay least under concatenation.

Rows are sorted over all conversations by range, so a long conversation is dealt over tasks. A task parses chunks of at
most ``CHUNK`` rows or ``CHUNK_CHARS`` characters; the chunks' cells of a conversation are combined in order, and every chunk
gets its states and its part of the audit back and edits its own rows. Rows equal in all columns are one row with a number
of copies. The audit alone fixes the repaired turns: each state admits one role for a new or changed turn.

Null roles and texts read as one space. Rows are ordered by turn (nulls first), role and text; null conversations form one
conversation. Empty texts are blank, repeated rows duplicates, long texts make chunks of their own. Empty tables give empty results,
extra columns are ignored. A role whose initial is none of s, u, a cannot be kept.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.sources import scratch

CHUNK = 512
CHUNK_CHARS = 1 << 20
RANGE_CHARS = 64

RE_ROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SPACES = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. The role each one admits next, beside a first system turn.
STATES = 4
NEXT = ("u", "u", "a", "u")
TO = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NAMES = {"u": "user", "a": "assistant"}
ACCEPTED = (0, 3)

#: (cost, audit) by state before and state after; None where no edit leads from one to the other.
Cell = list[list[tuple[int, str] | None]]


def _empty() -> Cell:
    return [[None] * STATES for _ in range(STATES)]


def _least(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return b if a is None else a if b is None else min(a, b)


def combine(left: Cell, right: Cell) -> Cell:
    out = _empty()
    for p, reached in enumerate(left):
        row = out[p]
        for a, onward in zip(reached, right, strict=True):
            if a is None:
                continue
            cost, audit = a
            for q, b in enumerate(onward):
                if b is None:
                    continue
                here, total = row[q], cost + b[0]
                if here is None or total < here[0] or (total == here[0] and audit + b[1] < here[1]):
                    row[q] = (total, audit + b[1])
    return out


def _closure() -> Cell:
    one = _empty()
    for p, x in enumerate(NEXT):
        one[p][p] = (0, "")
        one[p][TO[x][p]] = (INSERT, "I")
    return combine(combine(one, one), one)


CLOSURE = _closure()


@lru_cache(maxsize=4096)
def row_cell(initial: str, must_go: bool, cut_off: bool) -> Cell:
    """Edits of one row, with insertions around it. Cells are shared and never changed."""
    out, extra = _empty(), CUT_OFF * cut_off
    for p in range(STATES):
        out[p][p] = (DELETE, "D")
        if must_go:
            continue
        for x, cost, letter in ((NEXT[p], RE_ROLE, "R"), (initial, 0, "K")):
            q = TO[x][p] if x in TO else None
            if q is not None:
                out[p][q] = _least(out[p][q], (cost + extra, letter))
    return combine(combine(CLOSURE, out), CLOSURE)


def copies_cell(n: int) -> Cell:
    """The deletion of ``n`` more copies of a row. Insertions stand behind the last one, where an audit is least."""
    out = _empty()
    for p in range(STATES):
        out[p][p] = (DELETE * n, "D" * n)
    return combine(out, CLOSURE)


def span_cell(cells: list[Cell]) -> Cell:
    """The cell of all rows, from neighbouring spans of doubling length."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else CLOSURE


def edited(rows: list[tuple[str, str, int]], state: int, audit: str) -> list[tuple[str, str, str]]:
    """Turns (role, text, edit) that an audit makes of (role, text, copies), starting in a state."""
    out, at, used = [], 0, 0
    for letter in audit:
        role, text, n = rows[at] if at < len(rows) else ("", "", 0)
        if letter in "RI":
            x = NEXT[state]
            out.append((NAMES[x], text if letter == "R" else "", letter))
            state = TO[x][state]
        elif letter == "K":
            out.append((role, text, letter))
            state = TO[role[:1]][state]
        if letter != "I":
            used += 1
            if used == n:
                at, used = at + 1, 0
    return out


# Chunks


@dataclass
class _Chunk:
    """Rows of one conversation that follow each other, and what is counted in them."""

    conv: object
    rows: list[tuple[str, str, int]] = field(default_factory=list)
    cells: list[Cell] = field(default_factory=list)
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    n_turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        said = text.rstrip(SPACES)
        again = copies - 1 if first else copies
        cut_off = bool(said) and said[-1] not in ".!?"
        if not said:
            self.blank += copies
        else:
            self.duplicate += again
            self.truncated += first and cut_off
        if self.rows:
            self.illegal += self.rows[-1][0][:1] + role[:1] not in LEGAL
        self.illegal += copies - 1
        self.cells.append(row_cell(role[:1], not (said and first), cut_off))
        if copies > 1:
            self.cells.append(copies_cell(copies - 1))
        self.rows.append((role, text, copies))
        self.chars += len(text) + len(role)
        if turn is not None:
            self.n_turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def full(self) -> bool:
        return len(self.rows) >= CHUNK or self.chars >= CHUNK_CHARS

    def record(self, nth: int, part: int) -> dict:
        cell = span_cell(self.cells)
        flat = [x for row in cell for x in row]
        return {
            "conv_id": self.conv, "part": part, "chunk": nth, "rows": [{"role": r, "text": t, "n": n} for r, t, n in self.rows],
            "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat], "blank": self.blank,
            "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "n_turns": self.n_turns,
            "low": self.low, "high": self.high, "head": self.rows[0][0][:1], "tail": self.rows[-1][0][:1],
        }


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
_CELLS = "costs array<bigint>, audits array<string>, " + ", ".join(f"{c} bigint" for c in _COUNTS)
_CELLS += ", low bigint, high bigint, head string, tail string"
_ROWS = "rows array<struct<role: string, text: string, n: bigint>>"


def _arrow(kind: pa.DataType) -> pa.Schema:
    numbers = [(c, pa.int64()) for c in (*_COUNTS, "low", "high")]
    row = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])
    return pa.schema([
        ("conv_id", kind), ("part", pa.int64()), ("chunk", pa.int64()), ("rows", pa.list_(row)), ("costs", pa.list_(pa.int64())),
        ("audits", pa.list_(pa.string())), *numbers, ("head", pa.string()), ("tail", pa.string()),
    ])


def _gathered(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of some hundred records, or fewer with long texts."""
    held, chars = [], 0
    for record in records:
        held.append(record)
        chars += sum(len(row["text"]) for row in record.get("rows", ()))
        if len(held) >= 256 or chars >= CHUNK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(batches: Iterator[pa.RecordBatch], first: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in itertools.chain([first], batches):
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows that come sorted."""

    def records(rows: Iterator[tuple]) -> Iterator[dict]:
        held, nth, part = None, 0, TaskContext.get().partitionId()
        for conv, *row in rows:
            if held is not None and (held.full() or conv != held.conv):
                yield held.record(nth, part)
                held, nth = None, nth + 1
            held = held or _Chunk(conv)
            held.add(*row)
        if held is not None:
            yield held.record(nth, part)

    for first in batches:
        rows = _read(batches, first, ("conv_id", "turn", "role", "text", "n", "first"))
        yield from _gathered(records(rows), _arrow(first.schema.field("conv_id").type))


def _solved(chunks: pd.DataFrame) -> dict:
    """Cost, audit and counts of one conversation, and where each chunk starts and how it is edited."""
    chunks = chunks.sort_values(["part", "chunk"])
    cells = []
    for costs, audits in zip(chunks["costs"], chunks["audits"], strict=True):
        flat = [None if a is None else (int(c), a) for c, a in zip(costs, audits, strict=True)]
        cells.append([flat[p * STATES : (p + 1) * STATES] for p in range(STATES)])
    # Reached from the start: the least way into every state, and which state it came from.
    best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
    came = []
    for cell in cells:
        now: list[tuple[int, str] | None] = [None] * STATES
        back = [0] * STATES
        for p, q in ((p, q) for p in range(STATES) for q in range(STATES)):
            a, b = best[p], cell[p][q]
            if a is not None and b is not None and (now[q] is None or (a[0] + b[0], a[1] + b[1]) < now[q]):
                now[q], back[q] = (a[0] + b[0], a[1] + b[1]), p
        best = now
        came.append(back)
    end = min((best[q], q) for q in ACCEPTED if best[q] is not None)[1]
    states, q = [], end
    for back in reversed(came):
        q = back[q]
        states.insert(0, q)
    after = [*states[1:], end]
    low, high = chunks["low"].min(), chunks["high"].max()
    joints = list(zip(chunks["tail"][:-1], chunks["head"][1:], strict=True))
    shared = (chunks["low"].iloc[1:].to_numpy() == chunks["high"].ffill().iloc[:-1].to_numpy()).sum()
    return {
        "gaps": 0 if pd.isna(low) else int(high - low + 1 - chunks["n_turns"].sum() + shared),
        **{c: int(chunks[c].sum()) for c in _COUNTS[:3]},
        "illegal": int(chunks["illegal"].sum()) + sum(a + b not in LEGAL for a, b in joints),
        "cost": best[end][0], "audit": best[end][1],
        "edits": [
            {"part": int(part), "chunk": int(chunk), "state": p, "edits": cell[p][q][1]}
            for part, chunk, p, cell, q in zip(chunks["part"], chunks["chunk"], states, cells, after, strict=True)
        ],
    }


_SOLVED = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "edits array<struct<part: bigint, chunk: bigint, state: int, edits: string>>"
)


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [_solved(pd.DataFrame(list(c))) for c in batch["chunks"]]
        yield pd.concat([batch[["conv_id"]].reset_index(drop=True), pd.DataFrame(found)], axis=1) if found else batch.iloc[:0]


@dataclass
class Repaired:
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: repaired turns chunk
    by chunk (conv_id, part, chunk, turns), in the order of part and chunk."""

    conversations: DataFrame
    turns: DataFrame


def repair(spark: SparkSession, turns: DataFrame) -> Repaired:
    """Repairs ``turns`` (conv_id, turn, role, text). Runs three jobs that write chunks, and one that solves them, when called."""
    space = F.lit(" ")
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    ).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.md5("text").alias("m")).agg(F.min(place).alias("at"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.md5("text") == F.col("m"))
    marked = rows.join(first, same).withColumn("first", F.col("at.turn").eqNullSafe(F.col("turn")))
    marked = marked.select("conv_id", "turn", "role", "text", "n", "first")
    ranged = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS))
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, part bigint, chunk bigint, {_ROWS}, {_CELLS}"
    path = scratch.new_path(spark, "turn-chunks")
    ranged.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_chunked, schema).write.parquet(path)
    chunks = spark.read.schema(schema).parquet(path)

    cells = F.collect_list(F.struct(*[c for c in chunks.columns if c not in ("conv_id", "rows")])).alias("chunks")
    solved_path = scratch.new_path(spark, "turn-edits")
    chunks.groupBy("conv_id").agg(cells).mapInPandas(_combined, f"conv_id {kind}, {_SOLVED}").write.parquet(solved_path)
    solved = spark.read.schema(f"conv_id {kind}, {_SOLVED}").parquet(solved_path)

    edits = solved.select(F.explode("edits").alias("e")).select("e.*")

    @F.pandas_udf("array<struct<role: string, text: string, edit: string>>")
    def turns_of(rows: pd.Series, state: pd.Series, audit: pd.Series) -> pd.Series:
        done = []
        for r, s, a in zip(rows, state, audit, strict=True):
            made = edited([(x["role"], x["text"], x["n"]) for x in r], s, a)
            done.append([{"role": x, "text": t, "edit": e} for x, t, e in made])
        return pd.Series(done)

    made = chunks.select("conv_id", "part", "chunk", "rows").join(edits, ["part", "chunk"])
    made = made.select("conv_id", "part", "chunk", turns_of("rows", "state", "edits").alias("turns"))
    return Repaired(solved.drop("edits"), made)


def digests(repaired: Repaired) -> DataFrame:
    """(conv_id, repaired_sha256): digest of ``role:text`` of the repaired turns, joined by line feeds. A digest is sequential, so one
    task reads a whole conversation, piece by piece; it holds no more than a batch."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    pieces = repaired.turns.select("conv_id", "part", "chunk", F.size("turns").alias("n"), F.array_join(line, "\n").alias("piece"))

    def hashed(rows: Iterator[tuple]) -> Iterator[dict]:
        held, digest, said = None, None, False
        for conv, n, piece in rows:
            if digest is None or conv != held:
                if digest is not None:
                    yield {"conv_id": held, "repaired_sha256": digest.hexdigest()}
                held, digest, said = conv, hashlib.sha256(), False
            if n:
                digest.update((("\n" if said else "") + piece).encode())
                said = True
        if digest is not None:
            yield {"conv_id": held, "repaired_sha256": digest.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            schema = pa.schema([first.schema.field("conv_id"), ("repaired_sha256", pa.string())])
            yield from _gathered(hashed(_read(batches, first, ("conv_id", "n", "piece"))), schema)

    kind = dict(pieces.dtypes)["conv_id"]
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return ordered.select("conv_id", "n", "piece").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
