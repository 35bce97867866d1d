"""Reference lists held as text: parse, check and turn into ``array<bigint>`` without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the address that comes before the number of a cited work.
WORK_PREFIX = "https://openalex.org/W"

# Stands for one list element while the text around the elements is checked.
_MARK = "\u0001"


def _element(prefix: str) -> str:
    """One quoted element; the number is the second group."""
    literal = "".join("\\" + c if not c.isalnum() else c for c in prefix)
    return rf"""(['"])(?:{literal})?([+-]?[0-9]+)\1"""


def reference_numbers(text: Column, prefix: str = WORK_PREFIX) -> Column:
    """All numbers of a list text; a null text gives an empty list."""
    found = F.regexp_extract_all(text, F.lit(_element(prefix)), F.lit(2))
    numbers = F.transform(found, lambda v: v.cast("bigint"))
    return F.coalesce(numbers, F.array().cast("array<bigint>"))


def is_reference_list(text: Column, prefix: str = WORK_PREFIX) -> Column:
    """True when the text is a whole list literal of work addresses (null counts as a list).

    Elements are replaced by a mark and blanks are dropped, which leaves ``[m,m,m]``; taking out
    every ``m,`` must then leave ``[m]`` or ``[]``. No pattern repeats a group, so a list of any
    length is checked without deep regex recursion.
    """
    marked = F.regexp_replace(text, F.lit(_element(prefix)), F.lit(_MARK))
    bare = F.regexp_replace(marked, F.lit(r"\s"), F.lit(""))
    rest = F.replace(bare, F.lit(_MARK + ","), F.lit(""))
    whole = rest.isin("[]", f"[{_MARK}]") & (F.instr(text, _MARK) == 0)
    return text.isNull() | whole


def parse_reference_list(text: Column, mode: str = "strict", prefix: str = WORK_PREFIX) -> Column:
    """List text to ``array<bigint>``; null becomes an empty list.

    ``strict`` raises on malformed text, ``permissive`` gives null for it (see
    :func:`is_reference_list` to count the rejects).
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")
    numbers = reference_numbers(text, prefix)
    if mode == "strict":
        bad = F.raise_error(F.concat(F.lit("malformed reference list: "), text)).cast("array<bigint>")
    else:
        bad = F.lit(None).cast("array<bigint>")
    return F.when(is_reference_list(text, prefix), numbers).otherwise(bad)


def format_reference_list(refs: Column, prefix: str = WORK_PREFIX) -> Column:
    """``array<bigint>`` to list text, the inverse of :func:`parse_reference_list`."""
    quoted = F.transform(refs, lambda v: F.concat(F.lit("'" + prefix), v.cast("string"), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
