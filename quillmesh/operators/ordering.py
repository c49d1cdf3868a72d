"""Order-dependent operators that never sort a whole table in one task.

A window without a partition key runs in a single task.  Here rows are range
partitioned on the order key, written with their partition number, and the
small per-partition totals give every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import materialise

_SLICE = "__slice"
_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def _range_slices(df: DataFrame, order: Sequence[str], slices: int | None) -> DataFrame:
    parts = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(parts, *order).withColumn(_SLICE, F.spark_partition_id())
    return sliced


def dense_index(df: DataFrame, order: Sequence[str], name: str = "row_index", slices: int | None = None) -> DataFrame:
    """Number the rows 0..n-1 in the order of ``order``.

    The keys together must be unique: that fixes the numbering, and it lets
    range partitioning cut anywhere, which rows of equal keys would prevent.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    numbered = materialise(
        _range_slices(df, order, slices)
        .sortWithinPartitions(*order)
        .withColumn("__position", position),
        "indexed",
    )
    offsets = _running_offsets(numbered.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("__n")), ["__n"])
    return (
        numbered.join(F.broadcast(offsets), _SLICE)
        .withColumn(name, F.col("__position") + F.col("__before___n"))
        .drop(_SLICE, "__position", "__before___n")
    )


def prefix_sums(df: DataFrame, order: str, measures: Sequence[str], slices: int | None = None) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sum) for rows with distinct values of ``order``."""
    numbered = materialise(_range_slices(df, [order], slices), "prefix")
    totals = numbered.groupBy(_SLICE).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = _running_offsets(totals, measures)
    inside = Window.partitionBy(_SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = numbered.select("*", *[F.sum(m).over(inside).alias(f"__in_{m}") for m in measures])
    joined = summed.join(F.broadcast(offsets), _SLICE)
    for m in measures:
        joined = joined.withColumn(f"cum_{m}", F.col(f"__in_{m}") + F.col(f"__before_{m}"))
    return joined.select(*df.columns, *[f"cum_{m}" for m in measures])


def _running_offsets(totals: DataFrame, measures: Sequence[str]) -> DataFrame:
    # One row per range slice, so at most as many rows as shuffle partitions.
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        _SLICE,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__before_{m}") for m in measures],
    )


def consecutive_pairs(df: DataFrame, key: str, order: Sequence[str], value: str, slices: int | None = None) -> DataFrame:
    """(previous, current) values of neighbouring rows per key; the first row of a key has no pair.

    A key may hold any share of the rows, so the table is cut along (key, order)
    into slices of about equal counts, which are windowed apart.  Only the first
    key of a slice can have rows in the one before it, so a single row, the last
    of that slice, is carried over; there are as many of them as slices.  The
    order must be unique within a key.  A null key is a key like any other.
    """
    rows = df.select(key, *order, F.col(value).alias("current"))
    sliced = materialise(_range_slices(rows, [key, *order], slices), "pairs")
    ends = sliced.groupBy(_SLICE).agg(
        F.min(F.struct(key)).alias("__head"),
        F.max_by(F.struct(F.col(key).alias("key"), "current"), F.struct(key, *order)).alias("__tail"),
    )
    # one row per range slice; the struct lets a null value count as a previous row
    carried = ends.select(_SLICE, "__head", F.lag("__tail").over(Window.orderBy(_SLICE)).alias("__carried"))
    carried = carried.filter(F.col("__carried.key").eqNullSafe(F.col(f"__head.{key}")) & F.col("__carried").isNotNull())
    step = Window.partitionBy(_SLICE, key).orderBy(*order)
    inside = sliced.withColumn("__lag", F.lag(F.struct("current")).over(step))
    joined = inside.join(F.broadcast(carried), _SLICE, "left")
    over_edge = F.when(F.col("__carried.key").eqNullSafe(F.col(key)), F.struct(F.col("__carried.current").alias("current")))
    before = F.when(F.col("__carried").isNull(), F.col("__lag")).otherwise(F.coalesce("__lag", over_edge))
    paired = joined.withColumn("__before", before).filter("__before is not null")
    return paired.select(key, *order, F.col("__before.current").alias("previous"), "current")
