"""Personal data, and the terms that give it away.

Spans of four kinds (email, ip, card, phone) are found by pattern; each value is a protected entity. How much a term tells of an
entity is read from the corpus: with probabilities over all word places of the corpus, ``n(e,t)`` the places of term ``t`` within
``NEAR`` words of an occurrence of ``e`` and ``n(t)`` all its places,

    information of the entity     IC(e)    = -log2 p(e)
    what the term tells of it     PMI(e;t) =  log2 p(e,t) / (p(e) p(t))
    what stays unknown            IC(e) - PMI(e;t) = log2 n(t) / n(e,t)

A term discloses an entity where at most ``UNKNOWN_BITS`` stay unknown and two different surroundings of the entity hold it
(copies of one passage are one surrounding). It is disclosed in texts that hold both close to each other, and there all
places of the term are treated. Its general form, the first half of its letters, replaces it where
that form leaves more than ``UNKNOWN_BITS`` unknown (counts of all terms of that form); otherwise it is removed.

Counts cover every text with all its copies. One scan finds spans, surroundings and word counts and writes them; the rest works on
those. An entity or term that many rows share is summed before it is shuffled. Texts are told apart by digest, so ids may be null or
repeated, and equal texts get equal spans. Null texts count as empty; empty ones have no spans; an empty table gives no rows.
Texts are read whole, words in pieces; the words of a text with spans are held together. Extra columns are kept;
where a name clashes with a result (``spans``, ``key``), the result replaces it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm.arrow_runs import small
from citeframe.sources import scratch

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the corpus adds.
ADDED = ("general", "removed")
NEAR = 10
UNKNOWN_BITS = 1
#: Longer words are named by their digest.
LONG_WORD = 64
#: Characters that are split into words at a time, and distinct words that a task counts before it passes them on.
PIECE = 1 << 20
HELD_WORDS = 200_000

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\w+")
_WORD_END = re.compile(r"\W")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches at each ``@``: the characters before it, back to the last match, and the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _is_ip(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) < 4 and int(p or 0) < 256 for p in parts)


def _is_card(digits: str) -> bool:
    if not 12 <= len(digits) <= 19:
        return False
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(int(d) for d in digits[::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    found = [(start, 0, end) for start, end in _emails(text)]
    for m in _IP.finditer(text):
        if _is_ip(m[0]):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and _is_card(_NO_DIGIT.sub("", m[0])):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def entity(kind: str, match: str) -> str:
    """The value of a span, however it is written."""
    if kind == "email":
        return f"email {match.lower()}"
    if kind == "ip":
        return "ip " + ".".join(p.lstrip("0") or "0" for p in match.split("."))
    return f"{kind} {_NO_DIGIT.sub('', match)}"


def _named(word: str) -> str:
    word = word.lower()
    return word if len(word) <= LONG_WORD else "digest " + xxhash.xxh3_128_hexdigest(word.encode("utf-8", "surrogatepass"))


def _word_counts(text: str) -> Counter:
    counts: Counter = Counter()
    start = 0
    while start < len(text):
        cut = _WORD_END.search(text, start + PIECE) if start + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        counts.update(_WORD.findall(text[start:end]))
        start = end
    named: Counter = Counter()
    for word, n in counts.items():
        named[_named(word)] += n
    return named


def _outside(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Words that touch no span, and how many of them stand before each span."""
    words = []
    limits = sorted((start, end, i) for i, (_, start, end) in enumerate(spans))
    place = [0] * len(spans)
    reach, k = 0, 0
    for m in _WORD.finditer(text):
        while k < len(limits) and limits[k][0] < m.end():
            place[limits[k][2]] = len(words)
            reach = max(reach, limits[k][1])
            k += 1
        if m.start() >= reach:
            words.append((_named(m[0]), m.start(), m.end()))
    for start, _, i in limits[k:]:
        place[i] = len(words)
    return words, place


def surroundings(text: str, spans: list[tuple[str, int, int]], near: int) -> tuple[Counter, list[tuple], dict[str, list[tuple[int, int]]]]:
    """Word counts of a text; (entity, term, places of the term near the entity, least and greatest digest of a
    surrounding); all places of the terms near any entity."""
    words, before = _outside(text, spans)
    windows: dict[str, list[tuple[int, int]]] = {}
    for (kind, start, end), at in zip(spans, before, strict=True):
        windows.setdefault(entity(kind, text[start:end]), []).append((max(0, at - near), min(len(words), at + near)))
    rows = []
    for name, found in windows.items():
        terms: dict[str, list] = {}
        counted = 0
        for low, high in found:
            digest = xxhash.xxh3_64_intdigest(" ".join(w[0] for w in words[low:high]).encode("utf-8", "surrogatepass")) >> 1
            for i in range(low, high):
                seen = terms.setdefault(words[i][0], [0, digest, digest])
                seen[0] += i >= counted
                seen[1], seen[2] = min(seen[1], digest), max(seen[2], digest)
            counted = max(counted, high)
        rows += [(name, term, *seen) for term, seen in terms.items()]
    close = {r[1] for r in rows}
    places: dict[str, list[tuple[int, int]]] = {}
    for term, start, end in words:
        if term in close:
            places.setdefault(term, []).append((start, end))
    return Counter(w[0] for w in words), rows, places


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CLOSE = pa.struct([("entity", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_PLACES = pa.struct([("term", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_COUNTED = pa.struct([("term", pa.string()), ("n", pa.int64())])
_FOUND = pa.schema([
    ("key", pa.binary()), ("spans", pa.list_(_SPAN)), ("close", pa.list_(_CLOSE)), ("places", pa.list_(_PLACES)), ("counted", pa.list_(_COUNTED)),
])
_SPANS_SQL = "array<struct<kind: string, start: bigint, end: bigint>>"
_FOUND_SQL = (
    f"key binary, spans {_SPANS_SQL}, "
    "close array<struct<entity: string, term: string, n: bigint, low: bigint, high: bigint>>, "
    "places array<struct<term: string, starts: array<bigint>, ends: array<bigint>>>, counted array<struct<term: string, n: bigint>>"
)


def _read(near: int):
    names = {c: [f.name for f in t] for c, t in (("spans", _SPAN), ("close", _CLOSE))}

    def counted(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"counted": [{"term": t, "n": n} for t, n in words.items()]}], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in small(batches, "text", 2_000_000):
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = base_spans(text)
                close, places = [], {}
                if spans:
                    words, close, places = surroundings(text, spans, near)
                    held.update(words)
                else:
                    held.update(_word_counts(text))
                out.append({
                    "key": key, "spans": [dict(zip(names["spans"], s, strict=True)) for s in spans],
                    "close": [dict(zip(names["close"], c, strict=True)) for c in close],
                    "places": [{"term": t, "starts": [s for s, _ in at], "ends": [e for _, e in at]} for t, at in places.items()],
                })
            yield pa.RecordBatch.from_pylist(out, _FOUND)
            if len(held) > HELD_WORDS:
                yield counted(held)
                held = Counter()
        if held:
            yield counted(held)

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def general_form(term: Column) -> Column:
    return F.concat(F.substr(term, F.lit(1), F.ceil(F.char_length(term) / 2).cast("int")), F.lit("*"))


def read_corpus(spark: SparkSession, docs: DataFrame, text_col: str = "text", near: int = NEAR) -> DataFrame:
    """What one scan finds, written: a row for each text, and rows that hold word counts only (null key)."""
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    path = scratch.new_path(spark, "disclosure")
    texts.mapInArrow(_read(near), _FOUND_SQL).write.parquet(path)
    return spark.read.schema(_FOUND_SQL).parquet(path)


def disclosing_terms(found: DataFrame, unknown_bits: float = UNKNOWN_BITS) -> DataFrame:
    """(entity, term, n_near, n_term, unknown_bits, general): terms that disclose an entity. ``general`` says whether their
    general form does not."""
    share = 2.0**unknown_bits
    counts = found.select(F.explode("counted").alias("c")).groupBy("c.term").agg(F.sum("c.n").alias("n_term"))
    near = found.select(F.explode("close").alias("c")).select("c.*").groupBy("entity", "term").agg(
        F.sum("n").alias("n_near"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    form = general_form(F.col("term"))
    forms = counts.groupBy(form.alias("form")).agg(F.sum("n_term").alias("n_form"))
    told = near.filter("low != high").join(counts, "term").filter(F.col("n_term") <= share * F.col("n_near"))
    told = told.withColumn("form", form)
    near_forms = near.groupBy(F.col("entity").alias("e"), form.alias("f")).agg(F.sum("n_near").alias("near_form"))
    told = told.join(forms, "form").join(near_forms, (F.col("entity") == F.col("e")) & (F.col("form") == F.col("f")))
    return told.select(
        "entity", "term", "n_near", "n_term", F.log2(F.col("n_term") / F.col("n_near")).alias("unknown_bits"),
        (F.col("n_form") > share * F.col("near_form")).alias("general"),
    )


def added_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, added): places of disclosing terms in the texts that hold term and entity close to each other."""
    close = found.select("key", F.explode("close").alias("c")).select("key", "c.entity", "c.term").distinct()
    hit = close.join(terms.select("entity", "term", "general"), ["entity", "term"])
    hit = hit.groupBy("key", "term").agg(F.min("general").alias("general"))
    places = found.select("key", F.explode("places").alias("p")).select("key", "p.*").dropDuplicates(["key", "term"])
    kind = F.when(F.col("general"), ADDED[0]).otherwise(ADDED[1])
    span = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(kind.alias("kind"), x["starts"].alias("start"), x["ends"].alias("end")))
    return hit.join(places, ["key", "term"]).groupBy("key").agg(F.flatten(F.collect_list(span)).alias("added"))


def find_spans(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without their text, with ``key``, ``base`` (spans found by pattern) and ``added`` (spans of disclosing
    terms), both as arrays of (kind, start, end). Writes what it reads from the corpus and the spans of its texts when called."""
    found = read_corpus(spark, docs, text_col)
    held = found.filter(F.col("key").isNotNull() & (F.size("spans") > 0)).select("key", "spans").dropDuplicates(["key"])
    spans = held.join(added_spans(found, disclosing_terms(found)), "key", "left")
    path = scratch.new_path(spark, "disclosed")
    spans.select(F.col("key").alias("at_"), F.col("spans").alias("base"), "added").write.parquet(path)
    spans = spark.read.parquet(path)
    none = F.array().cast(_SPANS_SQL)
    kept = [c for c in docs.columns if c not in (text_col, "key", "base", "added")]
    rows = docs.select(*kept, text_key(F.col(text_col)).alias("key")).join(spans, F.col("key") == F.col("at_"), "left")
    return rows.select(*kept, "key", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with its spans replaced: base spans by their kind, general terms by their general form, others by a mark."""

    def one(t: str | None, found) -> str:
        t, out, done = t or "", [], 0
        for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in found):
            if end <= done:
                continue
            out.append(t[done : max(start, done)])
            word = t[start:end]
            out.append(word[: (len(word) + 1) // 2] + "*" if kind == ADDED[0] else f"[{kind.upper()}]" if start >= done else "")
            done = end
        return "".join(out) + t[done:]

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)], dtype=object)

    return run(text, spans)


def sanitise(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced and disclosing terms generalised or removed in their text."""
    spans = find_spans(spark, docs, text_col).select(F.col("key").alias("at_"), F.concat("base", "added").alias("spans_"))
    spans = spans.filter(F.size("spans_") > 0).dropDuplicates(["at_"])
    rows = docs.join(spans, text_key(F.col(text_col)) == F.col("at_"), "left")
    spans_ = F.coalesce("spans_", F.array().cast(_SPANS_SQL))
    changed = F.when(F.size(spans_) == 0, F.col(text_col)).otherwise(redacted(F.col(text_col), spans_))
    return rows.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])
