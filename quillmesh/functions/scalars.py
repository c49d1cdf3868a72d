"""Column-valued functions for cleaning text fields and packing small maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_to_zero(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("0"))


def safe_double(text: Column, default: float = 0.0) -> Column:
    """Number in ``text``, or ``default`` where it holds none."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def prefix_number(text: Column, length: int) -> Column:
    """Number in the first ``length`` characters, 0 where they are none."""
    return safe_double(F.substring(text, 1, length))


def signed_label(label: Column) -> Column:
    """{0, 1} to {-1, 1}."""
    return label * 2 - 1


def class_label(text: Column, negative: Sequence[str]) -> Column:
    """0 for the classes listed, 1 for any other."""
    return F.when(text.isin(*negative), 0).otherwise(1)


def code_from(text: Column, codes: Mapping[str, int], missing: str) -> Column:
    """Code from a fixed map; texts it does not list count as ``missing``."""
    entries = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), text), F.lit(codes[missing]))


def drop_positions(values: Column, positions: Sequence[int]) -> Column:
    """Array without the elements at the 0-based ``positions``."""
    return F.filter(values, lambda _, i: ~i.isin(*positions))


def keep_positions(values: Column, positions: Sequence[int], shift: int = 0) -> Column:
    """Array of the elements at ``positions`` (0-based, minus ``shift``), in that order."""
    return F.array(*[F.try_element_at(values, F.lit(p - shift + 1)) for p in positions])


def hash_unit(key: Column, seed: int | str = 0) -> Column:
    """Number in [0, 1) that depends only on the key and the seed, whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def parse_levels(packed: Column) -> Column:
    """Map from text such as ``a:1 b:2``."""
    return F.transform_values(F.str_to_map(packed, F.lit(" "), F.lit(":")), lambda _, v: v.try_cast("int"))


def pack_levels(levels: Column) -> Column:
    """Text such as ``a:1 b:2``, in the order of the names."""
    parts = F.transform(
        F.array_sort(F.map_entries(levels)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    )
    return F.array_join(parts, " ")


def merge_smallest(left: Column, right: Column) -> Column:
    """Union of two maps that keeps the smaller value of shared keys."""
    return F.map_zip_with(left, right, lambda _, a, b: F.least(a, b))
