"""Main text of web pages: the maximum-scoring contiguous run of tokens.

A page is a row of words and tags. Every word scores above zero: 1, raised or lowered by how often words in its surroundings
(the innermost open block, and whether in a link) belong to the content of labelled pages; a tag scores below zero,
the less often it stands in content the lower. One linear scan finds the contiguous run with the highest total. Parts of the
run that are no article text (forms, scripts, menus, adverts, notices, comments and so on) are left out, character
references are decoded, white space within a block becomes one space, and blocks are joined by an empty line.

Classes, ids and roles switch a part off, whatever its size, only where they name nothing but boilerplate (``ad``,
``cookie-notice``), the part holds no headline, article or main element, and words are left elsewhere on the page. Any other mention (``has-sidebar``, ``share-price``) is
evidence: the words in it have weights of their own, unless it holds a headline, article or main element.

Labelled pages are those that say where their content is, by an ``article`` or ``main`` element; the weights come from all of
them and are used on every page, whether it says so or not. Without any, fixed starting counts decide.

Null pages give an empty text. Unclosed and stray tags are read as far as they go; nothing is cut off. Ties between runs go to
the earliest start, then the longest run. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score of a tag that never stands in content, in words.
TAG_COST = 3.0
#: How far labelled pages raise or lower the score of a word, which is 1 without them.
WORD_CHANGE = 0.75

#: Elements whose text is no markup: they run to their end tag or the end of the page.
_RAW = "script|style|textarea|title|noscript|iframe"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+|[^<>]*)>|<[a-zA-Z/][^<>]*\Z|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)

# HTML element names and words that mark boilerplate.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
_INLINE = frozenset("a abbr b bdi bdo br cite code em font i img input label mark q s small span strong sub sup time u var".split())
_SHUT_TAG = re.compile(r"<(?:template|svg|math|canvas|select|button|object|audio|video)\b", re.IGNORECASE)
#: Left out with all they hold. One that is never closed ends where a block or a line begins.
_SHUT = frozenset("template svg math canvas select button object audio video".split())
_NEVER = frozenset("nav footer aside form menu dialog fieldset search".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus respond reply replies share "
    "sharing social related recommended newsletter subscribe signup login popup modal overlay widget pagination pager toolbar masthead "
    "contentinfo complementary search skip".split()
)
#: Words that say nothing else about a part than where or what shape it is.
_FITTING = frozenset(
    "area bar block body bottom box btn button buttons center container content count form header icon icons inner item items js left "
    "link links list outer panel right row section slot small text title top unit wrap wrapper".split()
)
#: Stands between links, and is no word alone.
_BETWEEN = string.whitespace + "\xa0<>|/·•«»-–—"
#: An open paragraph ends where one of these opens.
_ENDS_P = _BLOCK - {"body", "html", "caption", "option"}
_LISTED = _BLOCK | _INLINE | _VOID

#: Elements of running text, and the starting counts (in content, outside) of words and inline tags in them.
_PROSE = "p h1 h2 h3 h4 blockquote pre dd figcaption".split()
_PRIOR = (
    {f"w:{n}": (9, 1) for n in _PROSE} | {f"w:{n}+a": (3, 1) for n in _PROSE} | {f"w:{n}+m": (2, 1) for n in _PROSE} | {"w:li": (2, 1), "w:li+a": (1, 9)}
    | {f"w:{n}+a": (1, 9) for n in (_BLOCK | {"none"}) - {*_PROSE}} | {f"w:{n}+m": (1, 2) for n in (_BLOCK | {"none"}) - {*_PROSE}}
    | {f"t:{c}{n}|{b}": (9, 1) for c in ("", "/") for n in _INLINE - {"a"} for b in _BLOCK | {"none"}}
    | {f"t:{c}a|{b}": (9, 1) for c in ("", "/") for b in _PROSE}
    | {f"t:{c}{n}": (9, 1) for c in ("", "/") for n in _BLOCK} | {f"t:{c}{n}": (3, 1) for c in ("", "/") for n in ("li", "ul", "ol")}
)
#: Score of words and tags in parts that are left out anyway: a run may pass over them, but gains nothing.
_OFF = -0.02


def _self_closed(attributes: str) -> bool:
    return attributes.rstrip().endswith("/")


def _is_hidden(attributes: list[tuple[str, str]]) -> bool:
    return any(
        key == "hidden" or key == "aria-hidden" and value == "true"
        or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)
        for key, value in attributes
    )


def _mark(attributes: list[tuple[str, str]]) -> int:
    """2 where a class, id or role names nothing but boilerplate, 1 where it mentions some, else 0."""
    found = 0
    for key, value in attributes:
        if key not in ("class", "id", "role"):
            continue
        for label in value.split():
            parts = {x for x in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", label) if x and not x.isdigit()}
            if not _BOILERPLATE.isdisjoint(parts):
                found = max(found, 2 if parts <= _BOILERPLATE | _FITTING else 1)
    return found


class Token:
    """A run of words or a tag; ``off`` marks parts that are no article text, ``breaks`` the edges of blocks."""

    __slots__ = ("feature", "text", "n", "off", "breaks", "edge")

    def __init__(self, feature: str, text: str = "", n: int = 1, off: bool = False, breaks: bool = False, edge: int = 0):
        self.feature, self.text, self.n, self.off, self.breaks, self.edge = feature, text, n, off, breaks, edge


def _unclosed(page: str) -> set[int]:
    """Where elements of _SHUT open that no end tag closes."""
    open_: dict[str, list[int]] = {name: [] for name in _SHUT}
    for m in _TOKEN.finditer(page) if _SHUT_TAG.search(page) else ():
        name = (m[3] or "").lower()
        if name in _SHUT:
            if not m[2]:
                if not _self_closed(m[4] or ""):
                    open_[name].append(m.start())
            elif open_[name]:
                open_[name].pop()
    return {at for places in open_.values() for at in places}


def tokens(page: str) -> list[Token]:
    """Words and tags in order. ``edge``: +1 where an article or main element opens, -1 where it closes."""
    out: list[Token] = []
    open_: list[str] = []
    marks: list[list[int]] = []  # mark, first token and end of marked parts
    marked: list[tuple[int, int]] = []  # depth and number of the marks still open
    off_from = 0  # depth at which a part without article text began, 0 for none
    shut_from = 0  # the same for the elements of _SHUT
    unclosed_from = 0  # and for one of them that is never closed
    links = articles = 0

    def close(depth: int, end: int) -> None:
        nonlocal off_from, shut_from, unclosed_from, links, articles
        while len(open_) > depth:
            gone = open_.pop()
            links -= gone == "a"
            articles -= gone == "article"
        while marked and marked[-1][0] > depth:
            marks[marked.pop()[1]][2] = end
        off_from = off_from if off_from <= depth else 0
        shut_from = shut_from if shut_from <= depth else 0
        unclosed_from = unclosed_from if unclosed_from <= depth else 0

    def around() -> str:
        return next((x for x in reversed(open_) if x in _BLOCK), "none")

    def tag(mark: str, name: str) -> str:
        if name in _BLOCK:
            return f"t:{mark}{name}"
        return f"t:{mark}{name if name in _LISTED else 'other'}|{around()}"

    unclosed = _unclosed(page)
    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            raw = m[0]
            if raw[0] == "<" and len(raw) > 1 or shut_from:
                continue  # a comment, a raw element, a broken end or a part left out
            text = html.unescape(raw)
            n = len(text.split()) if text.strip(_BETWEEN) else 0
            if n or text:
                out.append(Token("w:" + around() + ("+a" if links else ""), text, n, bool(off_from)))
            continue
        name = name.lower()
        if m[2]:
            if shut_from and (name in open_[shut_from - 1 :] or name not in open_) or name in _SHUT:
                if name in open_:
                    close(len(open_) - 1 - open_[::-1].index(name), len(out))
                continue
            inside = bool(off_from)
            if name in open_:
                depth = len(open_) - 1 - open_[::-1].index(name)
                close(depth + 1, len(out))
                close(depth, len(out) + 1)
            out.append(Token(tag("/", name), off=inside, breaks=name in _BLOCK, edge=-1 if name in ("article", "main") else 0))
            continue
        if unclosed_from and (name in _BLOCK or name == "br"):
            close(unclosed_from - 1, len(out))
        if shut_from or name in _SHUT:
            if name not in _VOID and not _self_closed(m[4] or ""):
                open_.append(name)
                links += name == "a"
                articles += name == "article"
                shut_from = shut_from or len(open_)
                if m.start() in unclosed:
                    unclosed_from = unclosed_from or len(open_)
            continue
        if name in _ENDS_P and "p" in open_:
            close(len(open_) - 1 - open_[::-1].index("p"), len(out))
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1] == name:
            close(len(open_) - 1, len(out))
        attributes = m[4] or ""
        if name not in _VOID and not _self_closed(attributes):
            open_.append(name)
            links += name == "a"
            articles += name == "article"
            said = [(k.lower(), "".join(v).lower()) for k, *v in _ATTRIBUTE.findall(attributes)] if attributes else []
            mark = _mark(said)
            if not off_from:
                if name in _NEVER or name == "header" and not articles:
                    off_from = len(open_)
                elif name not in ("body", "html", "main", "article"):
                    if _is_hidden(said):
                        off_from = len(open_)
                    elif mark:
                        marked.append((len(open_), len(marks)))
                        marks.append([mark, len(out), 0])
                # A comment is often an article element of its own.
                if not off_from and (name in ("main", "h1") or name == "article" and mark < 2):
                    for _, k in marked:
                        marks[k][0] = 0
                    marked.clear()
        out.append(Token(tag("", name), off=bool(off_from), breaks=name in _BLOCK, edge=1 if name in ("article", "main") else 0))
        if name == "br":
            out.append(Token("w:" + around(), " ", 0, bool(off_from)))
    close(0, len(out))
    _judge(out, marks)
    return out


def _judge(row: list[Token], marks: list[list[int]]) -> None:
    """Switches off the marked parts that name nothing but boilerplate, whatever their size; the words of other ones get weights
    of their own, and so do all of them where nothing else would be left of the page."""
    marks = [m for m in marks if m[0]]
    off = [(start, end) for mark, start, end in marks if mark == 2]
    covered, to = [], 0
    for start, end in off:
        covered += [t for t in row[max(start, to) : end] if not t.off]
        to = max(to, end)
    left = sum(t.n for t in row if t.feature[0] == "w" and not t.off) - sum(t.n for t in covered if t.feature[0] == "w")
    if left > 0:
        for t in covered:
            t.off = True
        marks = [m for m in marks if m[0] == 1]
    to = 0
    for _, start, end in marks:
        for t in row[max(start, to) : end]:
            if t.feature[0] == "w" and not t.off:
                t.feature += "+m"
        to = max(to, end)


# Weights


def label_counts(pages) -> Counter:
    """(feature, in content?) counts of labelled pages."""
    found: Counter = Counter()
    for page in pages:
        if not page or not re.search(r"<(article|main)\b", page, re.IGNORECASE):
            continue
        depth = 0
        for t in tokens(page):
            depth = max(0, depth + min(0, t.edge))
            if not t.off:
                found[t.feature, depth > 0] += t.n
            depth += max(0, t.edge)
    return found


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    features = {f for f, _ in counts} | set(_PRIOR)
    out = {}
    for f in features:
        a, b = _PRIOR.get(f, (1, 1))
        share = (counts.get((f, True), 0) + a) / (counts.get((f, True), 0) + counts.get((f, False), 0) + a + b)
        out[f] = 2 * share - 1 if f[0] == "w" else -max(0.05, 1 - share) * TAG_COST
    return out


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages. Features are pairs of listed element names, so a few thousand rows at most reach
    the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            total += label_counts(batch.iloc[:, 0])
        yield pd.DataFrame([(f, inside, n) for (f, inside), n in total.items()], columns=["feature", "inside", "n"])

    rows = pages.select(html_col).mapInPandas(count, "feature string, inside boolean, n bigint")
    found = rows.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r.feature, r.inside): r.n for r in found})


# Extraction


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; the earliest and then longest of equals; empty if none is positive."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and start == at[0]:
            best, at = total, (start, i + 1)
    return at


def _score(t: Token, weight: dict[str, float]) -> float:
    if t.feature[0] == "t":
        return weight.get(t.feature, -TAG_COST / 2)
    return (1 + WORD_CHANGE * weight.get(t.feature, 0.0)) * t.n


def main_text(page: str | None, weight: dict[str, float]) -> str:
    if not page:
        return ""
    row = list(tokens(page))
    start, end = best_run([_OFF * t.n if t.off else _score(t, weight) for t in row])
    blocks, now = [], []
    for t in row[start:end]:
        if t.breaks:
            blocks.append("".join(now))
            now = []
        elif t.text and not t.off:
            now.append(t.text)
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(page: Column, weight: dict[str, float]) -> Column:
    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weight) for p in pages], dtype=object)

    return texts(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = pages.select("page_id", "url", extract(F.col("html"), learn(pages)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
