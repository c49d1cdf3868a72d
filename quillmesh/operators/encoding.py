"""Vocabularies, category codes and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.lookup import encode_from
from quillmesh.operators.ordering import dense_index


def long_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One (feature, value) row per cell of ``columns``."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells))


def vocabularies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values of every column with their 0-based code: (feature, value, code).

    One pass over the data; distinct values are combined before the shuffle,
    and numbered by range so a wide vocabulary is not sorted in one task.
    """
    distinct = long_cells(df, columns).filter("value is not null").distinct()
    numbered = dense_index(distinct, ["feature", "value"], "__n")
    first = numbered.groupBy("feature").agg(F.min("__n").alias("__first"))
    return numbered.join(F.broadcast(first), "feature").select(
        "feature", "value", (F.col("__n") - F.col("__first")).alias("code")
    )


def category_index(df: DataFrame, column: str) -> DataFrame:
    """(value, code) dictionary of one column in alphabetical order."""
    return vocabularies(df, [column]).select("value", "code")


def vocabulary_list(df: DataFrame, column: str, max_values: int = 1000) -> list[str]:
    """The sorted vocabulary on the driver; refuses one wider than ``max_values``."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_values + 1).collect()
    if len(values) > max_values:
        raise ValueError(f"{column} has over {max_values} values: use sparse_one_hot instead")
    return sorted(r[0] for r in values)


def one_hot(column: str, vocabulary: Sequence[str], prefix: str | None = None) -> list[Column]:
    """0/1 columns, one per vocabulary entry."""
    stem = prefix or column
    return [F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{stem}_{v}") for v in vocabulary]


def sparse_one_hot(df: DataFrame, column: str, dictionary: DataFrame, name: str) -> DataFrame:
    """Add a map {code: 1.0} for vocabularies too wide for one column per value."""
    codes = df.withColumn("__code", F.col(column))
    coded = encode_from(codes, ["__code"], dictionary, "value", "code")
    empty = F.create_map().cast("map<bigint,double>")
    hot = F.when(F.col("__code").isNotNull(), F.create_map(F.col("__code"), F.lit(1.0))).otherwise(empty)
    return coded.withColumn(name, hot).drop("__code")


def numeric_mean(df: DataFrame, column: str) -> float | None:
    """Mean of the cells that hold a number."""
    return df.agg(F.avg(F.col(column).try_cast("double"))).first()[0]


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    """Numbers of ``column``, with its mean where the cell holds none."""
    return df.withColumn(column, F.coalesce(F.col(column).try_cast("double"), F.lit(numeric_mean(df, column))))


def value_probabilities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, probability) of every value of every column."""
    counts = long_cells(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("rows"))  # one row per column
    return counts.join(F.broadcast(totals), "feature").select("feature", "value", (F.col("n") / F.col("rows")).alias("probability"))


def arities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, position, arity): distinct values per column, at its position in ``columns``."""
    counts = long_cells(df, columns).distinct().groupBy("feature").agg(F.count("value").alias("arity"))
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")) - 1
    return counts.select("feature", position.alias("position"), "arity")
