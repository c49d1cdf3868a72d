"""Row and column cleaning on whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_columns_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Without the columns at the 0-based ``positions``."""
    gone = set(positions)
    return df.select(*[c for i, c in enumerate(df.columns) if i not in gone])


def keep_columns_at(df: DataFrame, positions: Sequence[int], shift: int = 0) -> DataFrame:
    """Only the columns at ``positions``, given in a layout ``shift`` columns wider on the left."""
    return df.select(*[df.columns[p - shift] for p in positions])


def drop_marked(df: DataFrame, columns: Sequence[str], pattern: str = r"\?") -> DataFrame:
    """Without rows where any of ``columns`` matches the missing-value pattern."""
    for c in columns:
        df = df.filter(~F.coalesce(F.col(c).rlike(pattern), F.lit(False)))
    return df


def quarantine(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split into rows whose ``keys`` all parse as ids (cast to bigint) and the rejected rest."""
    parsed = {k: F.col(k).try_cast("bigint") for k in keys}
    ok = F.lit(True)
    for column in parsed.values():
        ok = ok & column.isNotNull()
    return df.filter(ok).withColumns(parsed), df.filter(~ok)


def value_counts_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One (value, 1) row per row and listed column."""
    cells = F.explode(F.array(*[F.col(c).cast("string") for c in columns]))
    return df.select(cells.alias("value"), F.lit(1).alias("one"))


def tokens(df: DataFrame, text: str, keep: Sequence[str] = (), pattern: str = r"\s+") -> DataFrame:
    """One row per non-empty token of the whole text."""
    return df.select(*keep, F.explode(F.split(text, pattern)).alias("token")).filter("token <> ''")


def token_list(text: str, pattern: str = r"\s+") -> Column:
    """Non-empty tokens of the whole text as one array."""
    return F.filter(F.split(text, pattern), lambda w: w != "")


def dense_features(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def sparse_features(columns: Sequence[str]) -> Column:
    """map<int,double> of the non-zero entries."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("key"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0))


def sparse_dimension(df: DataFrame, features: str) -> DataFrame:
    """One row: greatest used index + 1."""
    return df.agg((F.max(F.array_max(F.map_keys(features))) + 1).alias("dimension"))
