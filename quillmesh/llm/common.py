"""Helpers the training-data operators share: byte-level words, 64-bit hashing, table pass-through."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_word_hash = xxhash.xxh3_64_intdigest

# ASCII characters that are neither letters nor digits become blanks, letters lower case.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def blank_words(text: str | None) -> list[bytes]:
    """Words between blanks (x20, x09 to x0D), A to Z in lower case; none for null."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None, full_case: bool = False) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters in lower case.

    ``full_case`` also lowers non-ASCII letters.
    """
    if not text:
        return []
    return (text.lower() if full_case else text).encode().translate(_ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), dtype=U64, count=len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` words, in order; none if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    for k in range(size):
        total = total * U64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


_TABLES: list = []  # caches of tables that a worker keeps between its tasks


def worker_table(load: Callable) -> Callable:
    """Keep what ``load`` returns for the later tasks of a worker, until the worker runs another module's operator."""
    cached = lru_cache(maxsize=2)(load)
    _TABLES.append(cached)
    return cached


def release_others(module: str) -> None:
    """Drop the tables of all modules but ``module``; workers outlive their job, and so would its tables."""
    held = [t for t in _TABLES if t.__module__ != module and t.cache_info().currsize]
    for table in held:
        table.cache_clear()
    if held:
        pa.default_memory_pool().release_unused()


def map_batches(
    df: DataFrame, schema: T.StructType | str, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """Apply ``rows`` to each Arrow batch of ``df``; memory is bounded by one batch."""
    module = rows.__module__

    def run(batches):
        release_others(module)
        for batch in batches:
            yield from rows(batch)

    return df.mapInArrow(run, schema)


def list_array(parts: list[np.ndarray], dtype: pa.DataType) -> pa.Array:
    """A list column out of one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, dtype))


def text_key():
    """128 bits that stand for a text in joins: equal texts get equal verdicts (null counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.md5(text)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, so that callers' extra columns never clash."""
    name = base
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
