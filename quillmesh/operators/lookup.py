"""Dictionary joins; whether a side is small enough to broadcast is decided by Spark's own size check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Column,
    how: str = "inner",
) -> DataFrame:
    """Join with a dictionary: broadcast below Spark's byte threshold, otherwise a shuffled (skew-split) join."""
    return left.join(right, on, how)


def encode_from(
    df: DataFrame,
    columns: Sequence[str],
    dictionary: DataFrame,
    key: str,
    code: str,
    default: int | float | None = None,
) -> DataFrame:
    """Replace each of ``columns`` by its code in one dictionary, ``default`` where it has none."""
    out = df
    for column in columns:
        side = dictionary.select(F.col(key).alias(f"__key_{column}"), F.col(code).alias(f"__code_{column}"))
        out = out.join(side, F.col(column) == F.col(f"__key_{column}"), "left")
        value = F.col(f"__code_{column}")
        out = out.withColumn(column, value if default is None else F.coalesce(value, F.lit(default)))
        out = out.drop(f"__key_{column}", f"__code_{column}")
    return out
