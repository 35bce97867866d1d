import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from citeframe.llm import queries, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def solve(rows):
    """All edit sequences, cheapest first and least audit first, as a search over (row, roles so far) with a bounded cost."""
    best = None
    for cap in range(0, 5 * len(rows) + 8):
        stack, found = [(0, 0, "", "", ())], []
        seen = set()
        while stack:
            at, cost, audit, shape, out = stack.pop()
            if cost > cap or (at, cost, audit, shape) in seen:
                continue
            seen.add((at, cost, audit, shape))
            if not re.fullmatch(r"s?(u|a|ua|au)*", shape) or re.search(r"uu|aa|^s?a", shape):
                continue
            if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", shape):
                found.append((cost, audit, out))
            for x in "ua":
                stack.append((at, cost + 2, audit + "I", shape + x, (*out, f"{NAMES[x]}:")))
            if at < len(rows):
                role, text, gone, cut = rows[at]
                stack.append((at + 1, cost + 3, audit + "D", shape, out))
                if not gone:
                    stack.append((at + 1, cost + cut, audit + "K", shape + (role[:1] or "?"), (*out, f"{role}:{text}")))
                    for x in "ua":
                        stack.append((at + 1, cost + 2 + cut, audit + "R", shape + x, (*out, f"{NAMES[x]}:{text}")))
        if found:
            best = min(found)
            break
    return best


def judged(rows):
    """Rows of a conversation in order, with what is counted."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        cut = bool(said) and said[-1] not in ".!?"
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if cut else None
        if fault:
            counts[fault] += 1
        seen.add((role, text))
        out.append((role, text, fault in ("blank", "duplicate"), int(cut)))
    turns = {r[0] for r in rows if r[0] is not None}
    counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    return out, counts


def expect(by_conv):
    want = {}
    for conv, rows in by_conv.items():
        ordered, counts = judged(rows)
        cost, audit, made = solve(ordered)
        want[conv] = counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest()}
    return want


def found(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("first", F.lit(1))
    done = turn_repair.repair(spark, table.repartition(4))
    hashed = turn_repair.digests(done)
    both = done.conversations.join(hashed.withColumnRenamed("conv_id", "c"), F.col("c").eqNullSafe(F.col("conv_id")))
    assert both.count() == done.conversations.count()
    return {r["conv_id"]: {k: r[k] for k in r.asDict() if k not in ("conv_id", "c")} for r in both.collect()}


def _random_rows(rng, n_conv, most):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "  ", "", None, "Why?", "Well!\n", "and"]
    rows = []
    for conv in [*range(n_conv), None]:
        for turn in range(rng.randint(1, most)):
            t = rng.choice([turn, turn, turn, turn + 1, None])
            rows.append((conv, t, rng.choice(roles if rng.random() < 0.3 else roles[:2]), rng.choice(texts)))
    return rows


def _by_conv(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return by


@pytest.mark.parametrize("chunk", [512, 2])
def test_repairs_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(turn_repair._Chunk, "full", lambda self: len(self.rows) >= chunk)
    rows = _random_rows(random.Random(chunk), 14, 5)
    assert found(spark, rows) == expect(_by_conv(rows))


def test_spans_combine_the_same_at_every_split():
    rng = random.Random(1)
    cells = [turn_repair.row_cell(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(9)]
    whole = turn_repair.span_cell(cells)
    for k in range(1, 9):
        assert turn_repair.combine(turn_repair.span_cell(cells[:k]), turn_repair.span_cell(cells[k:])) == whole


def test_long_and_copied_rows(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " + "x" * (3_000_000 if i == 5 else 3) + ".") for i in range(2000)]
    rows += [(2, 0, "user", "Hello.")] * 700 + [(2, 1, "assistant", "Hello.")]
    got = found(spark, rows)
    plain = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:2000])
    assert got[1]["audit"] == "K" * 2000
    assert got[1]["repaired_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    assert (got[2]["audit"], got[2]["duplicate"], got[2]["illegal"], got[2]["cost"]) == ("K" + "D" * 699 + "K", 699, 699, 3 * 699)


def test_no_rows(spark):
    assert found(spark, []) == {}


def test_query_damages_rows(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for conv, turn, role, text in rows:
        at = by.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if fault:
            at += [(turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * (1 + (fault == 3))
    want = expect({c: r for c, r in by.items() if r})
    got = {r["conv_id"]: r.asDict() for r in queries.op12_turn_repair(spark, sf).collect()}
    assert set(got) == set(by)
    for conv, row in got.items():
        row.pop("conv_id")
        if by[conv]:
            assert row == want[conv]
        else:
            assert (row["audit"], row["cost"], row["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
