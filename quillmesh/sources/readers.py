"""Readers for delimited text, labelled vectors, graphs and ratings.

Every reader takes an explicit schema or parses a line with column
expressions, so nothing is inferred by an extra pass over the files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmesh.session import scratch_path

CTRL_A = "\u0001"


def read_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """Lines of a file, folder or glob; ``partitions`` only raises the parallelism of later stages."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.repartition(partitions) if partitions else lines


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", **options) -> DataFrame:
    """Delimited files under an explicit schema; empty trailing fields stay as columns."""
    reader = spark.read.schema(schema).option("sep", sep).option("lineSep", "\n")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def read_ctrl_a(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_delimited(spark, path, schema, sep=CTRL_A)


def read_census(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields separated by comma and blank."""
    return read_delimited(spark, path, schema, sep=", ", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def split_fields(line: Column, sep: str = ",") -> Column:
    """All fields of a trimmed line, trailing empty ones included (``sep`` is a regular expression)."""
    return F.split(F.trim(line), sep, -1)


def _numbers(texts: Column) -> Column:
    return F.transform(texts, lambda x: x.try_cast("double"))


def dense_points(lines: DataFrame, labelled: bool = True) -> DataFrame:
    """``label f1 f2 ...`` (or only features) separated by blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    if not labelled:
        return lines.select(_numbers(parts).alias("features"))
    rest = F.slice(parts, F.lit(2), F.size(parts) - 1)
    return lines.select(parts[0].try_cast("double").alias("label"), _numbers(rest).alias("features"))


def labelled_points(lines: DataFrame) -> DataFrame:
    """``label,f1 f2 ...``"""
    halves = F.split(F.trim("value"), ",", 2)
    features = _numbers(F.split(F.trim(halves[1]), r"\s+"))
    return lines.select(halves[0].try_cast("double").alias("label"), features.alias("features"))


def point_literals(lines: DataFrame) -> DataFrame:
    """``(label,[f1,f2,...])``"""
    label = F.regexp_extract("value", r"^\s*\(\s*([^,\s]+)\s*,", 1).try_cast("double")
    inner = F.regexp_extract("value", r"\[([^\]]*)\]", 1)
    return lines.select(label.alias("label"), _numbers(F.split(inner, r"\s*,\s*")).alias("features"))


def read_libsvm(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """LIBSVM files; giving the width saves the pass that finds the largest index."""
    reader = spark.read.format("libsvm")
    return (reader if width is None else reader.option("numFeatures", str(width))).load(path)


def vertices_with_tail(lines: DataFrame) -> DataFrame:
    """``id,attr,attr,...`` with any number of attributes."""
    parts = F.split("value", ",")
    return lines.select(
        parts[0].try_cast("bigint").alias("id"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("attrs")
    ).filter("id is not null")


def fact_edges(lines: DataFrame, sep: str = CTRL_A) -> DataFrame:
    """Edges whose first six fields form one fact text; blanks of the sixth become ``^``.

    Lines whose ends are no ids, or with fewer fields, are dropped.
    """
    parts = F.split("value", sep, -1)
    tail = F.translate(F.try_element_at(parts, F.lit(6)), " ", "^")
    fact = F.concat_ws(":", F.array_join(F.slice(parts, 1, 5), ":"), tail)
    return lines.select(
        F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("src"),
        F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("dst"),
        F.when(F.size(parts) >= 6, fact).alias("fact"),
    ).filter("src is not null and dst is not null and fact is not null")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "user int, item int, rate double")


def dictionary_from_lines(lines: DataFrame) -> DataFrame:
    """(name, code) from lines ``code,name``, the way a lookup file is kept."""
    parts = F.split(F.trim("value"), ",", 2)
    return lines.select(parts[1].alias("name"), parts[0].try_cast("double").alias("code")).filter("code is not null")


@dataclass(frozen=True)
class Loaded:
    """What one reading of a file gave: rows, the lines that are none, and how many of both."""

    good: DataFrame
    rejects: DataFrame  # value: the line as it was
    n_good: int
    n_rejected: int


def load_checked(lines: DataFrame, fields: Mapping[str, Column], required: Sequence[str]) -> Loaded:
    """Parse lines once into rows and rejects, both written below the scratch folder.

    ``fields`` are expressions over ``value``; a line in which one of
    ``required`` is null is a reject.  The counts are observed by the same pass.
    """
    spark = lines.sparkSession
    whole = F.lit(True)
    for name in required:
        whole = whole & fields[name].isNotNull()
    row = F.when(whole, F.struct(*[c.alias(n) for n, c in fields.items()]))
    parsed = lines.select(row.alias("row"), F.when(~whole, F.col("value")).alias("value"), (~whole).alias("rejected"))
    seen = Observation()
    counted = parsed.observe(
        seen, F.count_if(~F.col("rejected")).alias("good"), F.count_if(F.col("rejected")).alias("rejected")
    )
    path = scratch_path(spark, "loaded")
    counted.write.partitionBy("rejected").parquet(path)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema.fields if f.name != "rejected")
    saved = spark.read.schema(f"{kind}, rejected boolean").parquet(path)
    good = saved.filter("not rejected").select("row.*")
    return Loaded(good, saved.filter("rejected").select("value"), seen.get["good"], seen.get["rejected"])


def edge_fields(sep: str = " ") -> tuple[dict[str, Column], list[str]]:
    """``src dst``"""
    parts = F.split(F.trim("value"), sep, -1)
    ends = {n: F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i, n in enumerate(("src", "dst"), 1)}
    return ends, ["src", "dst"]


def vertex_fields() -> tuple[dict[str, Column], list[str]]:
    """``id,attr,attr,...``"""
    parts = F.split("value", ",", -1)
    return {"id": parts[0].try_cast("bigint"), "attrs": F.slice(parts, F.lit(2), F.size(parts) - 1)}, ["id"]


def fact_fields(sep: str = CTRL_A) -> tuple[dict[str, Column], list[str]]:
    """Ends and one fact text of six fields, as in ``fact_edges``."""
    parts = F.split("value", sep, -1)
    ends, required = edge_fields(sep)
    tail = F.translate(F.try_element_at(parts, F.lit(6)), " ", "^")
    fact = F.when(F.size(parts) >= 6, F.concat_ws(":", F.array_join(F.slice(parts, 1, 5), ":"), tail))
    return ends | {"fact": fact}, [*required, "fact"]


def dictionary_fields() -> tuple[dict[str, Column], list[str]]:
    """``code,name``"""
    parts = F.split(F.trim("value"), ",", 2)
    return {"name": F.try_element_at(parts, F.lit(2)), "code": parts[0].try_cast("double")}, ["name", "code"]
