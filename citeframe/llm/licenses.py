"""Licence scan: winnowed fingerprints find candidates, banded alignment measures them.

Templates and texts are sequences of words (ASCII letters, digits and everything beyond ASCII, ASCII lowered). Of every
``WINNOW`` neighbouring ``GRAM``-grams the one with the least hash is a fingerprint, so a copied run of ``GRAM + WINNOW - 1`` words
always shares one. The templates' fingerprints form an inverted index to (template, place); a text's fingerprints are looked
up in it, and hits on about the same diagonal make a candidate. Each candidate is aligned within a band around its diagonal,
which gives the template words found in order (coverage) and the runs of the text they stand in (spans).

Texts are read whole. The index is sent to the tasks, for at most ``BLOCK`` template words at a time; more templates take more
passes. Null and empty texts have no matches; every row of a repeated document reports its own. Of matches of one template
that overlap, the one with the most words counts, then the first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citeframe.llm.arrow_runs import small
from citeframe.llm.license_texts import TEMPLATES

GRAM = 3
WINNOW = 3
#: Words that a match may be shifted against its template: a share of the template's words, up to a limit.
BAND = 12
BAND_SHARE = 4
#: Most diagonals that are aligned together.
WIDEST = 256
COVERAGE = 0.8
#: Most template words of one pass.
BLOCK = 1_000_000
#: Bytes that are hashed at a time.
PIECE = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
for _b in range(256):
    _IN_WORD[_b] = _b >= 128 or chr(_b).isalnum()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word. A word's hash is that of its bytes and length."""
    inside = np.concatenate([[False], _IN_WORD[data], [False]])
    start, end = (np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1]))
    hashes = np.zeros(len(start), np.uint64)
    left = np.arange(len(start))
    at, stop = start.copy(), end
    low = _LOWER[data] if len(data) else data
    while len(left):  # one byte of all words that still have one
        hashes[left] = (hashes[left] ^ low[at[left]]) * np.uint64(_BASE) + np.uint64(1)
        hashes[left] ^= hashes[left] >> np.uint64(29)
        at[left] += 1
        left = left[at[left] < stop[left]]
    return _mix(hashes), start, end


def fingerprints(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed grams of word sequences laid end to end: hash and place. ``owner`` tells sequences apart."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : n + i]
    grams = _mix(grams)
    place = np.flatnonzero(owner[:n] == owner[GRAM - 1 :])
    grams, group = grams[place], owner[place]
    best = np.zeros(len(place), bool)
    least = np.full(len(place), -1)
    for shift in range(WINNOW):  # the least of this and the next grams of the same sequence
        other = np.arange(len(place)) + shift
        there = other < len(place)
        there[there] &= group[other[there]] == group[there]
        first = least < 0
        better = there & (first | (grams[np.minimum(other, len(place) - 1)] <= grams[np.maximum(least, 0)]))
        least = np.where(better, other, least)
    whole = np.ones(len(place), bool)  # shorter sequences have one window only
    ends = np.flatnonzero(np.diff(group)) + 1
    begin = np.concatenate([[0], ends]).astype(np.int64)
    finish = np.concatenate([ends, [len(group)]]).astype(np.int64)
    if len(place):
        last = np.repeat(finish, finish - begin) - WINNOW
        whole = (np.arange(len(place)) <= last) | (np.arange(len(place)) == np.repeat(begin, finish - begin))
        best[least[whole]] = True
    return grams[best], place[best]


class Index:
    """Inverted index of templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.sequences = [words(np.frombuffer(t.encode(), np.uint8))[0] for t in templates.values()]
        owner = np.repeat(np.arange(len(self.names)), [len(s) for s in self.sequences])
        start = np.concatenate([[0], np.cumsum([len(s) for s in self.sequences])])
        grams, place = fingerprints(np.concatenate([*self.sequences, np.zeros(0, np.uint64)]), owner)
        order = np.argsort(grams, kind="stable")
        self.grams, place = grams[order], place[order]
        self.template = owner[place] if len(place) else place
        self.place = place - start[self.template]

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the gram, number of the posting)."""
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        n = high - low
        hit = np.repeat(np.arange(len(grams)), n)
        return hit, np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, spread: int = BAND) -> list[int]:
    """Words of the text that the longest common subsequence within the band matches, in order."""
    m, width = len(template), 2 * spread + 1
    reach = diagonal - spread + np.arange(width)
    table = np.zeros((m + 1, width), np.int32)
    same = np.zeros((m, width), bool)
    for i in range(m):
        at = reach + i
        good = (at >= 0) & (at < len(text))
        same[i, good] = text[at[good]] == template[i]
        up = np.concatenate([table[i, 1:], table[i, -1:]])  # the same word of the text, one template word less
        table[i + 1] = np.maximum.accumulate(np.maximum(up, table[i] + same[i]))
    found, i, k = [], m, width - 1
    while i > 0 and table[i, k] > 0:
        if k and table[i, k - 1] == table[i, k]:
            k -= 1
        elif same[i - 1, k] and table[i - 1, k] + 1 == table[i, k]:
            found.append(int(reach[k] + i - 1))
            i -= 1
        else:
            i, k = i - 1, min(k + 1, width - 1)
    return found[::-1]


def band_of(n_words: int) -> int:
    """A short statement's words must stand close together, or a longer notice of the same licence would hold them too."""
    return min(BAND, n_words // BAND_SHARE + 1)


def _stretches(diagonals: np.ndarray, band: int) -> Iterator[tuple[int, int]]:
    """First and last of the neighbouring diagonals that are aligned together. Long stretches are cut into overlapping
    ones, so that memory does not grow with the text."""
    for group in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > band) + 1):
        low, last = int(group[0]), int(group[-1])
        while last - low > WIDEST:
            yield low, low + WIDEST
            low += WIDEST // 2
        yield low, last


def _runs(places: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def matches(text: np.ndarray, hits: dict[int, list[int]], index: Index, coverage: float) -> Iterator[tuple[int, list[int]]]:
    """(template, matched words of the text). hits: diagonals by template."""
    for template, diagonals in hits.items():
        words_ = index.sequences[template]
        band = band_of(len(words_))
        found = []
        for low, high in _stretches(np.unique(diagonals), band):
            got = align(words_, text, (low + high) // 2, band + (high - low + 1) // 2)
            if len(got) >= coverage * len(words_):
                found.append(got)
        taken: list[tuple[int, int]] = []
        for got in sorted(found, key=lambda g: (-len(g), g[0])):
            if all(got[-1] < a or got[0] > b for a, b in taken):
                taken.append((got[0], got[-1]))
                yield template, got


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan_text(raw: bytes, index: Index, coverage: float) -> list[tuple]:
    """(template, matched words, coverage, spans in characters) of one text with candidates."""
    hashes, start, end = words(np.frombuffer(raw, np.uint8))
    grams, place = fingerprints(hashes, np.zeros(len(hashes), np.int64))
    hit, posting = index.lookup(grams)
    by: dict[int, list[int]] = defaultdict(list)
    for t, d in zip(index.template[posting].tolist(), (place[hit] - index.place[posting]).tolist(), strict=True):
        by[t].append(d)
    out = []
    places = None
    for template, got in matches(hashes, by, index, coverage):
        if places is None:  # characters that begin before each byte
            places = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        spans = [{"start": int(places[start[a]]), "end": int(places[end[b - 1]])} for a, b in _runs(got)]
        n = len(index.sequences[template])
        out.append((index.names[template], len(got), len(got) / n, spans))
    return out


def _touched(texts: list[bytes], index: Index) -> list[int]:
    """Numbers of the texts that share a fingerprint with a template. Texts are hashed together."""
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, start, _ = words(np.frombuffer(b"\n".join(texts), np.uint8))
    grams, place = fingerprints(hashes, np.searchsorted(ends, start, "right") - 1)
    at = np.searchsorted(index.grams, grams)
    hit = index.grams[np.minimum(at, len(index.grams) - 1)] == grams
    return np.unique(np.searchsorted(ends, start[place[hit]], "right") - 1).tolist()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, matched_words, coverage, spans) of every match; spans count characters from 0, ends
    not included."""
    templates = TEMPLATES if templates is None else templates
    passes: list[dict[str, str]] = [{}]
    for name, text in templates.items():
        if passes[-1] and sum(len(t.split()) for t in passes[-1].values()) + len(text.split()) > BLOCK:
            passes.append({})
        passes[-1][name] = text
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, matched_words int, coverage double, spans array<struct<start: bigint, end: bigint>>"

    def look(part: dict[str, str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(part)
            for batch in small(batches, "text", PIECE):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
                known: dict[bytes, list[tuple]] = {}
                rows, found = [], []
                for i in _touched(texts, index) if len(index.grams) else ():
                    if texts[i] not in known:
                        known[texts[i]] = _scan_text(texts[i], index, coverage)
                    rows += [i] * len(known[texts[i]])
                    found += known[texts[i]]
                if not rows:
                    continue
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows)), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
                        pa.array(columns[2], pa.float64()), pa.array(columns[3], _SPANS),
                    ],
                    ["doc_id", "license", "matched_words", "coverage", "spans"],
                )

        return run

    out = None
    for part in passes:
        found = docs.select("doc_id", "text").mapInArrow(look(part), schema)
        out = found if out is None else out.union(found)
    return out
