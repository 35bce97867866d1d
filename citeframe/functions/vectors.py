"""Vectors as ``array<float>``: packing, padding, layout and class decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_columns(n_features: int, prefix: str = "embedding_") -> list[str]:
    return [f"{prefix}{i}" for i in range(n_features)]


def pack(n_features: int, prefix: str = "embedding_") -> Column:
    """Wide feature columns to one ``array<float>``."""
    return F.array(*[F.col(c).cast("float") for c in feature_columns(n_features, prefix)])


def unpack(vector: str, n_features: int, prefix: str = "embedding_") -> list[Column]:
    """One array to wide feature columns."""
    return [F.col(vector)[i].alias(c) for i, c in enumerate(feature_columns(n_features, prefix))]


def pad_vector(n: int | Column, pad: float = 0.0) -> Column:
    return F.array_repeat(F.lit(pad).cast("float"), F.lit(n) if isinstance(n, int) else n)


def clean_vector(vector: Column, n_features: int, pad: float = 0.0) -> Column:
    """Pad in place of null elements or a null vector; a vector of the wrong width is an error.

    ``array_contains`` gives false only when the vector has neither the probe nor a null, so the
    element-wise rewrite runs for the few vectors that need it and the rest stay in generated code.
    """
    floats = vector.cast("array<float>")
    fill = F.lit(pad).cast("float")
    whole = F.array_contains(floats, F.lit(float("-inf")).cast("float")) == F.lit(False)
    filled = F.when(whole, floats).otherwise(F.transform(floats, lambda x: F.coalesce(x, fill)))
    wrong = F.raise_error(F.concat(F.lit("vector width "), F.size(floats).cast("string"))).cast("array<float>")
    return (
        F.when(floats.isNull(), pad_vector(n_features, pad))
        .when(F.size(floats) == n_features, filled)
        .otherwise(wrong)
    )


def assemble(steps: Column, timepoints: int, n_features: int, pad: float = 0.0) -> Column:
    """Step vectors (oldest slot last, focal at the end) to one flat vector, padded on the left."""
    missing = F.lit(timepoints + 1) - F.size(steps)
    return F.concat(pad_vector(missing * F.lit(n_features), pad), F.flatten(steps))


def unflatten(features: Column, timepoints: int, n_features: int) -> Column:
    """Flat vector to ``timepoints + 1`` step vectors."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(timepoints)),
        lambda i: F.slice(features, i * F.lit(n_features) + F.lit(1), F.lit(n_features)),
    )


def wide_step_columns(features: Column, timepoints: int, n_features: int, prefix: str = "embedding_") -> list[Column]:
    """Flat vector to named columns ``{prefix}{feature}_{rank}``, then ``{prefix}{feature}``."""
    names = [f"{prefix}{f}_{r}" for r in reversed(range(timepoints)) for f in range(n_features)]
    names += feature_columns(n_features, prefix)
    return [features[i].alias(name) for i, name in enumerate(names)]


def checked_width(features: Column, timepoints: int, n_features: int) -> Column:
    """The vector itself, or an error when it has not the fixed example width."""
    width = (timepoints + 1) * n_features
    wrong = F.raise_error(F.concat(F.lit("example width "), F.size(features).cast("string"))).cast("array<float>")
    return F.when(F.size(features) == width, features).otherwise(wrong)


def target_vector(y_cols: Sequence[str], fill: float | None = None) -> Column:
    """Label columns to one float vector; ``fill`` replaces null labels."""
    cols = [F.col(c).cast("float") for c in y_cols]
    if fill is not None:
        cols = [F.coalesce(c, F.lit(fill).cast("float")) for c in cols]
    return F.array(*cols).cast("array<float>")


def predicted_class(probability: Column, threshold: float = 0.5) -> Column:
    """Class 1 strictly above the threshold; null for a probability that is NaN."""
    return F.when(~F.isnan(probability), (probability > F.lit(threshold)).cast("int"))
