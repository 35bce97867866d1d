"""Expanding-window folds over publication time, row roles and the leakage audit.

Folds are a handful of parameters, so roles are plain column expressions on each paper: no join, no
shuffle, and nothing of a fold travels but literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions.timeline import FOLD_YEAR_NS, year_start_ns
from citeframe.operators.slicing import meets

ROLES = ("train", "val", "test")


@dataclass(frozen=True)
class Fold:
    """Epoch-nanosecond windows ``[train_start, val_start)``, ``[val_start, test_start)``, ``[test_start, test_end)``."""

    end_year: int
    train_start: int
    val_start: int
    test_start: int
    test_end: int

    def window(self, role: str) -> tuple[int, int]:
        return {
            "train": (self.train_start, self.val_start),
            "val": (self.val_start, self.test_start),
            "test": (self.test_start, self.test_end),
        }[role]


def make_folds(
    start_year: int, end_year: int, start_train: int, val_size: int, test_size: int, delta: int = 1
) -> list[Fold]:
    """Folds whose ends go from the first possible year up to, not including, ``end_year``.

    Validation and test sizes are years of 52 weeks; training always starts at ``start_year``.
    """
    if test_size > delta:
        raise ValueError("test_size must not be larger than delta")
    folds = []
    for end in range(start_year + start_train + val_size + test_size, end_year, delta):
        test_start = year_start_ns(end) - test_size * FOLD_YEAR_NS
        folds.append(
            Fold(
                end_year=end,
                train_start=year_start_ns(start_year),
                val_start=test_start - val_size * FOLD_YEAR_NS,
                test_start=test_start,
                test_end=test_start + test_size * FOLD_YEAR_NS,
            )
        )
    return folds


def in_role(fold: Fold, role: str, boundary: str = "exclusive", date_col: str = "publication_date_int") -> Column:
    """Whether a paper has a role in a fold.

    ``exclusive`` tests the paper's own date against the half-open window; ``overlap`` takes every paper
    of a slice that touches the closed window (needs ``slice_start`` and ``slice_end``).
    """
    low, high = fold.window(role)
    if boundary == "exclusive":
        return (F.col(date_col) >= F.lit(low)) & (F.col(date_col) < F.lit(high))
    return meets(low, high, boundary)


def assign_roles(
    papers: DataFrame,
    folds: Sequence[Fold],
    boundary: str = "exclusive",
    id_col: str = "id",
    date_col: str = "publication_date_int",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(id, fold, role)`` and the kept columns, one per role a paper has."""
    cases = [
        F.when(
            in_role(f, role, boundary, date_col),
            F.struct(F.lit(f.end_year).alias("fold"), F.lit(role).alias("role")),
        )
        for f in folds
        for role in ROLES
    ]
    rows = papers.select(F.col(id_col).alias("id"), *keep, F.explode(F.array(*cases)).alias("r"))
    return rows.where(F.col("r").isNotNull()).select("id", *keep, "r.fold", "r.role")


def fold_table(
    papers: DataFrame, folds: Sequence[Fold], boundary: str = "exclusive", date_col: str = "publication_date_int"
) -> DataFrame:
    """One row per fold: its bounds and the number of papers in each role, from a single pass."""
    rows = [
        F.struct(
            F.lit(f.end_year).alias("fold"),
            F.lit(f.train_start).alias("train_start"),
            F.lit(f.val_start).alias("val_start"),
            F.lit(f.test_start).alias("test_start"),
            F.lit(f.test_end).alias("test_end"),
            *[F.count_if(in_role(f, role, boundary, date_col)).alias(f"n_{role}") for role in ROLES],
        )
        for f in folds
    ]
    return papers.agg(F.array(*rows).alias("folds")).select(F.inline("folds"))


def leakage_audit(
    papers: DataFrame, folds: Sequence[Fold], boundary: str = "exclusive", date_col: str = "publication_date_int"
) -> DataFrame:
    """Per fold, the papers that hold two roles at once. Ids are unique, so no regrouping is needed."""

    def both(f: Fold, a: str, b: str) -> Column:
        return F.count_if(in_role(f, a, boundary, date_col) & in_role(f, b, boundary, date_col))

    def several(f: Fold) -> Column:
        held = [in_role(f, role, boundary, date_col).cast("int") for role in ROLES]
        return F.count_if(held[0] + held[1] + held[2] > 1)

    rows = [
        F.struct(
            F.lit(f.end_year).alias("fold"),
            both(f, "train", "val").alias("train_val"),
            both(f, "val", "test").alias("val_test"),
            both(f, "train", "test").alias("train_test"),
            several(f).alias("n_leaked"),
        )
        for f in folds
    ]
    return papers.agg(F.array(*rows).alias("folds")).select(F.inline("folds"))


def reference_leakage(
    papers: DataFrame, references: DataFrame, folds: Sequence[Fold], id_col: str = "id", date_col: str = "publication_date_int"
) -> DataFrame:
    """Per fold, the references of training papers that are dated in its validation or test window, and those papers.

    ``references`` are rows ``(id, ref_date)``, as kept for the examples. Nothing bars a reference younger than its paper, so the
    counts show what a model may see of a later window. They are summed per paper first, so a much-cited or long-listed paper
    is no hot group; a reference without a date lies in no window.
    """

    def dated(low: int, high: int) -> Column:
        return F.count_if((F.col("ref_date") >= F.lit(low)) & (F.col("ref_date") < F.lit(high)))

    counts = [
        dated(*f.window(role)).alias(f"_{role}_{f.end_year}") for f in folds for role in ("val", "test")
    ]
    per_paper = references.groupBy("id").agg(*counts)
    rows = papers.select(F.col(id_col).alias("id"), F.col(date_col)).join(per_paper, "id", "left")

    def found(f: Fold) -> Column:
        training = in_role(f, "train", "exclusive", date_col)
        val, test = (F.coalesce(F.col(f"_{role}_{f.end_year}"), F.lit(0)) for role in ("val", "test"))
        return F.struct(
            F.lit(f.end_year).alias("fold"),
            F.coalesce(F.sum(F.when(training, val)), F.lit(0)).alias("val_references"),
            F.coalesce(F.sum(F.when(training, test)), F.lit(0)).alias("test_references"),
            F.count_if(training & (val + test > 0)).alias("n_papers"),
        )

    return rows.agg(F.array(*[found(f) for f in folds]).alias("folds")).select(F.inline("folds"))
