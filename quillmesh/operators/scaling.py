"""Column statistics in one pass, and the scalings that use them.

``fit_stats`` runs one aggregate for all columns and returns plain numbers, so
applying a scaling is a map that fuses with whatever surrounds it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnStats:
    least: float
    greatest: float
    mean: float
    std: float  # population


def stats_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    measures = []
    for c in columns:
        x = F.col(c).cast("double")
        measures += [
            F.min(x).alias(f"{c}__least"),
            F.max(x).alias(f"{c}__greatest"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_pop(x).alias(f"{c}__std"),
        ]
    return df.agg(*measures)


def stats_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, least, greatest, mean, std), one row per column."""
    names = ("least", "greatest", "mean", "std")
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").alias(n) for n in names]) for c in columns]
    )
    return stats_row(df, columns).select(F.inline(rows))


def fit_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    row = stats_row(df, columns).first()
    return {c: ColumnStats(*[row[f"{c}__{n}"] for n in ("least", "greatest", "mean", "std")]) for c in columns}


def _ratio(numerator: Column, denominator: float) -> Column:
    """A constant column scales to 0."""
    return F.lit(0.0) if not denominator else numerator / F.lit(denominator)


def z_score(x: Column, s: ColumnStats) -> Column:
    return _ratio(x - s.mean, s.std)


def min_max(x: Column, s: ColumnStats) -> Column:
    return _ratio(x - s.least, s.greatest - s.least)


def log_shift(x: Column, s: ColumnStats | None = None) -> Column:
    return F.log10(x + 1)


def log_min_max(x: Column, s: ColumnStats) -> Column:
    """log10 of the min-max value + 1."""
    return F.log10(min_max(x, s) + 1)


def log_space_min_max(x: Column, s: ColumnStats) -> Column:
    """Min-max after log10(x + 1)."""
    low, high = math.log10(s.least + 1), math.log10(s.greatest + 1)
    return _ratio(F.log10(x + 1) - low, high - low)


def log_ratio(x: Column, s: ColumnStats) -> Column:
    return _ratio(F.log10(x + 1), math.log10(s.greatest))


def centred(x: Column, s: ColumnStats) -> Column:
    return x - s.mean


def arctan_squash(x: Column, s: ColumnStats | None = None) -> Column:
    return F.atan(x) * 2 / F.pi()


def thousand_steps(x: Column, s: ColumnStats) -> Column:
    """Position on a 1000-step scale, to two decimals."""
    return F.round(_ratio(x - s.least, (s.greatest - s.least) / 1000), 2)


SCALINGS = {
    "z_score": z_score,
    "min_max": min_max,
    "log_shift": log_shift,
    "log_min_max": log_min_max,
    "log_space_min_max": log_space_min_max,
    "log_ratio": log_ratio,
    "centred": centred,
    "arctan_squash": arctan_squash,
    "thousand_steps": thousand_steps,
}


def scale(
    df: DataFrame, columns: Sequence[str], how: str, stats: dict[str, ColumnStats] | None = None
) -> DataFrame:
    """Scale ``columns``; pass the training table's ``stats`` to scale another table alike."""
    fitted = stats or fit_stats(df, columns)
    f = SCALINGS[how]
    return df.withColumns({c: f(F.col(c).cast("double"), fitted[c]) for c in columns})
