"""A SentencePiece model of type BPE as a search for the one compatible path.

Merging neighbours by rank gives exactly the sequence of pieces in which every two neighbours are compatible: merging the
characters of the two alone gives the two back. So encoding is a best-path problem over pieces, with minus infinity for
incompatible neighbours, and can be solved in max-plus algebra from any point of a text, given the piece that reaches over it.

No piece holds a word mark behind another character, nor a character outside the vocabulary, so texts fall into units that
can be encoded alone. Short units are merged directly and remembered.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache

import numpy as np

MARK = "▁"
#: Units up to this length are merged directly; longer ones are searched.
SHORT = 64
#: Units and pairs of pieces remembered at most, some 50 to 80 MB each; a memory starts anew when it is full.
REMEMBERED = 250_000
NONE = float("-inf")


class Pieces:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.texts[i]: i for i in plain}
        self.score = {self.texts[i]: model.get_score(i) for i in plain}
        self.bytes_ = {int(self.texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.raw = [self._raw(i, model) for i in range(n)]
        self.known = frozenset("".join(self.ids)) & frozenset(self.ids)
        inner = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if inner or "\n" in self.known or len(self.bytes_) != 256:
            raise ValueError("pieces hold word marks inside or line ends, or bytes are missing")
        self._units = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self._compatible: dict[tuple[str, str], bool] = {}
        self._memory: dict[str, bytes] = {}

    def _raw(self, i: int, model) -> bytes:
        if model.is_byte(i):
            return bytes([int(self.texts[i][3:5], 16)])
        if model.is_control(i):
            return b""
        return self.texts[i].replace(MARK, " ").encode()

    # Texts

    @staticmethod
    def marked(text: str) -> str:
        """The text as the model sees it: a mark in front and for every space. A mark that the text itself holds is put
        aside as a lone surrogate, which no text holds, and written as bytes, so that it comes back as what it was."""
        return MARK + text.replace(MARK, "\udc81").replace(" ", MARK) if text else ""

    def token_ids(self, piece: str) -> list[int]:
        """Id of a piece, the byte ids of a character that is none, or the ids of a run of marks."""
        if piece[0] == MARK == piece[-1] and len(piece) > 1:
            return [self.ids[p] for p in self.merge(piece)]
        if piece in self.ids:
            return [self.ids[piece]]
        piece = MARK if piece == "\udc81" else piece
        return [self.bytes_[b] for b in piece.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        whole = b"".join([self.raw[i] for i in ids])
        return whole[1:].decode("utf-8", "replace") if whole[:1] == b" " else whole.decode("utf-8", "replace")

    # Merging

    def merge(self, unit: str) -> list[str]:
        """Pieces by merging the best neighbours first, the leftmost of equals."""
        score = self.score
        out = list(unit)
        if len(out) > SHORT:
            return self._merge_long(out)
        ranks = [score.get(out[i] + out[i + 1], NONE) for i in range(len(out) - 1)]
        while ranks:
            best = max(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = score.get(out[i] + out[i + 1], NONE)
            if i:
                ranks[i - 1] = score.get(out[i - 1] + out[i], NONE)
        return out

    def _merge_long(self, out: list[str]) -> list[str]:
        """The same with a heap and linked neighbours."""
        score, n = self.score, len(out)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := out[i] + out[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not out[i] or j >= n or out[i] + out[j] != p:
                continue
            out[i], out[j] = p, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := out[x] + out[y]) in score:
                    heapq.heappush(heap, (-score[q], x, q))
        return [p for p in out if p]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two can stand side by side. Before a word, a run of marks acts as its last mark does."""
        if right[0] == MARK:
            return True  # a word begins; ``ending`` sees to runs of marks
        if left[-1] == MARK and left[0] == MARK:
            left = MARK
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > REMEMBERED:
                self._compatible.clear()
            known = self._compatible[key] = self.merge(left + right) == [left, right]
        return known

    def ending(self, text: str, start: int, end: int) -> list[str]:
        """Pieces and single characters of a text that end at ``end`` and do not begin before ``start``. Marks merge with
        each other only after all else, so a run of marks counts as one, with or without the last mark."""
        if text[end - 1] == MARK:
            begin, stop = end - 1, end
            while begin > start and text[begin - 1] == MARK:
                begin -= 1
            while stop < len(text) and text[stop] == MARK and stop < end + 2:
                stop += 1
            return [text[begin:end]] if stop - end < 2 else []
        score = self.score
        found = [p for n in range(min(self.longest, end - start), 1, -1) if (p := text[end - n : end]) in score]
        return [*found, text[end - 1]]

    def last_pieces(self, text: str, start: int, end: int, first: str | None = None) -> dict[int, str]:
        """For every position that a compatible path from ``start`` reaches, the last piece of that path. ``first`` is a piece
        before ``start``."""
        last: dict[int, str | None] = {start: first}
        for p in range(start + 1, end + 1):
            for piece in self.ending(text, start, p):
                at = p - len(piece)
                if at in last and (last[at] is None or self.compatible(last[at], piece)):
                    last[p] = piece
                    break
        return last

    @staticmethod
    def traced(last: dict[int, str], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def unit_pieces(self, unit: str) -> list[str]:
        if len(unit) <= SHORT or MARK * 2 in unit:
            return self.merge(unit)
        return self.traced(self.last_pieces(unit, 0, len(unit)), 0, len(unit))

    def unit_ids(self, unit: str) -> bytes:
        """Ids of a unit as packed 32-bit numbers."""
        found = self._memory.get(unit)
        if found is None:
            found = array("i", [i for p in self.unit_pieces(unit) for i in self.token_ids(p)]).tobytes()
            if len(unit) <= SHORT:
                if len(self._memory) >= REMEMBERED:
                    self._memory.clear()
                self._memory[unit] = found
        return found

    def units(self, marked: str) -> list[str]:
        return self._units.findall(marked)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_marked(self.marked(text))

    def encode_marked(self, marked: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.unit_ids, self.units(marked))), np.int32)


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)
