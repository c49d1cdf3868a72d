"""Sinks: text of keyed rows, snapshots, one-file exports, LIBSVM and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def pair_text(key: str | Column, value: str | Column) -> Column:
    """``(key,value)``, the text form of a keyed row."""
    as_column = [F.col(c) if isinstance(c, str) else c for c in (key, value)]
    return F.concat(F.lit("("), F.concat_ws(",", *[c.cast("string") for c in as_column]), F.lit(")"))


def write_pairs(df: DataFrame, path: str, key: str, value: str) -> None:
    df.select(pair_text(key, value).alias("value")).write.text(path)


def write_lines(df: DataFrame, path: str, columns: Sequence[str], sep: str = ",") -> None:
    """One line per row with fields joined by ``sep``; null fields are empty.

    A field that holds the separator or a line end would shift its line when
    read back, so it fails the job.
    """

    def field(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        breaks = text.contains(sep) | text.contains("\n")
        return F.when(breaks, F.raise_error(F.concat(F.lit(f"{name} holds a separator: "), text))).otherwise(text)

    fields = [field(c) for c in columns]
    df.select(F.concat_ws(sep, *fields).alias("value")).write.text(path)


def write_kept(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Parquet written by as many tasks as the rows come from.

    ``one_file`` shuffles the finished rows into one file at the end; what
    leads to them still runs in parallel.
    """
    (df.repartition(1) if one_file else df).write.parquet(path)


def strip_parentheses(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite saved text without ``(`` and ``)``."""
    cleaned = spark.read.text(source).select(F.regexp_replace("value", r"[()]", "").alias("value"))
    cleaned.write.text(target)


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    df.select(F.col(label).alias("label"), F.col(features).alias("features")).write.format("libsvm").save(path)


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a fixed order."""
    return df.orderBy(*order).limit(n)
