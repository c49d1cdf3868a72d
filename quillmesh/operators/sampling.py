"""Splits and class balancing, both random (seeded) and by key hash (repeatable on any partitioning)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.scalars import hash_unit
from quillmesh.operators.ordering import dense_index


def random_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    return df.randomSplit(list(weights), seed)


def hash_part(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Number of the part a key falls in; the parts have the given relative sizes."""
    unit, whole, bound = hash_unit(key, seed), sum(weights), 0.0
    part = F.lit(len(weights) - 1)
    conditions = []
    for i, w in enumerate(weights[:-1]):
        bound += w / whole
        conditions.append((bound, i))
    for bound, i in reversed(conditions):
        part = F.when(unit < bound, i).otherwise(part)
    return part


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: rows per class, their ratio, share of positives."""
    positive, negative = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        positive.alias("positives"),
        negative.alias("negatives"),
        F.try_divide(positive.cast("double"), negative).alias("ratio"),
        F.try_divide(positive.cast("double"), positive + negative).alias("positive_share"),
    )


def majority_ratio(df: DataFrame, label: str, minority: int = 1) -> float:
    """Rows of the other class per row of ``minority``."""
    counts = df.agg(
        F.count_if(F.col(label) != minority).alias("others"), F.count_if(F.col(label) == minority).alias("few")
    ).first()
    return counts["others"] / counts["few"] if counts["few"] else 0.0


def oversample_random(df: DataFrame, label: str, factor: float, seed: int, minority: int = 1) -> DataFrame:
    """All other rows, and the minority drawn with replacement ``factor`` times over."""
    few = df.filter(F.col(label) == minority)
    return df.filter(F.col(label) != minority).unionByName(few.sample(True, float(factor), seed))


def oversample_by_key(df: DataFrame, label: str, key: str, factor: float, seed: int = 0, minority: int = 1) -> DataFrame:
    """Repeat every minority row floor(factor) times, and a hash-chosen share of them once more."""
    whole, rest = int(factor), factor - int(factor)
    extra = (hash_unit(F.col(key), seed) < rest).cast("int")
    copies = F.when(F.col(label) == minority, F.lit(whole) + extra).otherwise(1)
    return (
        df.withColumn("__copies", copies)
        .filter("__copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .drop("__copies")
    )


def duplicate_class(df: DataFrame, label: str, value: int = 1) -> DataFrame:
    """Every row, and the rows of one class a second time."""
    return df.unionByName(df.filter(F.col(label) == value))


def undersample_random(df: DataFrame, label: str, fractions: dict, seed: int) -> DataFrame:
    return df.sampleBy(label, fractions, seed)


def undersample_by_key(
    df: DataFrame, label: str, key: str, fraction: float, seed: int = 0, majority: int = 0
) -> DataFrame:
    """All other rows, and the hash-chosen ``fraction`` of the majority class."""
    kept = (F.col(label) != majority) | (hash_unit(F.col(key), seed) < fraction)
    return df.filter(kept)


# Draws made in one pass over the table; more would widen the aggregate's plan without end.
DRAWS_PER_PASS = 64


def seeded_draws(df: DataFrame, key: str, columns: Sequence[str], draws: int, seed: int = 42) -> DataFrame:
    """One row per draw 1..``draws``, each an independent seeded choice over all rows: (draw, key, columns).

    Draw ``i`` takes the row whose key has the least hash under seed + i.
    Every task keeps one candidate per draw, so a pass is one aggregate
    without a shuffle of rows.
    """
    row = F.struct(key, *columns)

    def rank(i: int) -> Column:
        return F.struct(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed + i)))), F.col(key))

    passes = []
    for first in range(1, draws + 1, DRAWS_PER_PASS):
        numbers = range(first, min(first + DRAWS_PER_PASS, draws + 1))
        chosen = df.agg(F.array(*[F.min_by(row, rank(i)) for i in numbers]).alias("rows"))
        placed = chosen.select(F.posexplode("rows").alias("place", "row")).filter("row is not null")
        passes.append(placed.select((F.col("place") + first).alias("draw"), "row.*"))
    return reduce(DataFrame.unionByName, passes)


def positioned_draws(df: DataFrame, key: str, columns: Sequence[str], draws: int, seed: int = 42) -> DataFrame:
    """As ``seeded_draws``, by position: draw ``i`` takes the row whose number in the order of the key is a hash of seed + i.

    Keys are unique and not null.  However many draws there are, the keys are
    numbered once and the drawn positions joined once, and no row is hashed.
    """
    indexed = dense_index(df.select(key).filter(F.col(key).isNotNull()), [key], "__place")
    rows = indexed.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    number = F.conv(F.substring(F.md5((F.col("id") + F.lit(seed)).cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    wanted = df.sparkSession.range(1, draws + 1).select(F.col("id").alias("draw"), (number % max(rows, 1)).alias("__place"))
    keys = indexed.join(wanted, "__place").select("draw", key)
    return df.select(key, *columns).join(keys, key).select("draw", key, *columns)
