"""Benchmark decontamination by greedy string tiling.

1. Seeds: every window of five tokens of a benchmark item.  Documents are
   screened against a bitmap of fixed size (``BITMAP_BITS``) made from the seed
   hashes, then joined with the seeds themselves, so that texts are never
   shuffled and most of them end at the bitmap.
2. Only the tokens around seed hits travel on: a tile of five tokens or more
   lies within them.
3. Each (document, item) pair is tiled by running Karp-Rabin matching: the
   longest common token runs that do not overlap earlier tiles are marked, in
   rounds of falling search length.
4. The share of the item's tokens under tiles is the coverage.  Tiles may sit
   in any order, so reordered passages count in full.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, alnum_words, fresh_name, list_array, map_batches, mix, shingle_hashes, signed, text_key, word_hashes
from quillmesh.session import materialise

SEED_WORDS = 5
COVERAGE = 0.7
BITMAP_BITS = 24  # 2 MB whatever the size of the benchmark; a full bitmap only screens less


def _tokens(text: str | None) -> np.ndarray:
    return word_hashes(alnum_words(text, full_case=True))


def _seeds_of(tokens: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    return {k: mix(shingle_hashes(tokens, k) + U64(k)) for k in lengths}


def benchmark_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``item_id, item`` with its token hashes, ``seed, seed_words, item_id``); items without a token never match."""

    def rows(batch: pa.RecordBatch):
        tokens = [_tokens(t) for t in batch.column(1).to_pylist()]
        seeds = [np.unique(_seeds_of(t, [min(SEED_WORDS, len(t))])[min(SEED_WORDS, len(t))]) if len(t) else t for t in tokens]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                list_array([signed(t) for t in tokens], pa.int64()),
                list_array([signed(s) for s in seeds], pa.int64()),
            ],
            names=["item_id", "item", "seeds"],
        )

    read = map_batches(
        benchmark.select(F.col("item_id").cast("long"), "text"), "item_id bigint, item array<bigint>, seeds array<bigint>", rows
    )
    items = materialise(read.filter(F.size("item") > 0).distinct(), "items")
    words = F.least(F.size("item"), F.lit(SEED_WORDS)).alias("seed_words")
    return items.select("item_id", "item"), items.select(F.explode("seeds").alias("seed"), words, "item_id").distinct()


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Seed hashes as bits; at most 2^18 words of 64 bits come to the driver, however many seeds there are."""
    slot = F.col("seed").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = seeds.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits")
    )
    table = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def _screen(docs: DataFrame, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """Documents with a likely seed: its hashes, and the tokens around the hits with their positions."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def rows(batches):
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            keep, hits, where, tokens = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                t = _tokens(text)
                near, seen = np.zeros(len(t), dtype=bool), []
                for k, seeds in _seeds_of(t, lengths).items():
                    at = np.flatnonzero(bits[seeds & U64((1 << BITMAP_BITS) - 1)])
                    if len(at):
                        seen.append(seeds[at])
                        for step in range(k):
                            near[at + step] = True
                if seen:
                    keep.append(i)
                    hits.append(signed(np.unique(np.concatenate(seen))))
                    where.append(np.flatnonzero(near).astype(np.int32))
                    tokens.append(signed(t[near]))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column(0),
                    kept.column(1),
                    kept.column(3),
                    list_array(hits, pa.int64()),
                    list_array(where, pa.int32()),
                    list_array(tokens, pa.int64()),
                ],
                names=["row_id", "doc_id", "text_key", "hits", "positions", "tokens"],
            )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key")
    )
    schema = (
        "row_id bigint, doc_id bigint, text_key string, hits array<bigint>, positions array<int>, tokens array<bigint>"
    )
    return numbered.mapInArrow(rows, schema)


def tile(item: list[int], tokens: list[int], positions: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in document, length), longest first, by running Karp-Rabin.

    A match never runs across a gap in ``positions``.
    """
    breaks = [1] * (len(tokens) + 1)
    for j in range(len(tokens) - 1, -1, -1):  # tokens left in the run that starts at j
        breaks[j] = breaks[j + 1] + 1 if j + 1 < len(tokens) and positions[j + 1] == positions[j] + 1 else 1
    in_item, in_doc = [False] * len(item), [False] * len(tokens)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), 32))

    def windows(values, taken, size, run=None):
        base, mod = 1_000_003, (1 << 61) - 1
        top = pow(base, size - 1, mod)
        h = 0
        free = 0  # unmarked values in a row that end here
        for j, v in enumerate(values):
            h = ((h - values[j - size] * top) * base + v) % mod if j >= size else (h * base + v) % mod
            free = 0 if taken[j] else free + 1
            start = j - size + 1
            if free >= size and (run is None or run[start] >= size):
                yield start, h

    while True:
        table = defaultdict(list)
        for t, h in windows(tokens, in_doc, length, breaks):
            table[h].append(t)
        matches, longer = [], 0
        for p, h in windows(item, in_item, length):
            for t in table.get(h, ()):
                if item[p : p + length] != tokens[t : t + length]:
                    continue
                k = length
                while (
                    p + k < len(item) and k < breaks[t] and not in_item[p + k] and not in_doc[t + k] and item[p + k] == tokens[t + k]
                ):
                    k += 1
                if k > 2 * length:
                    longer = max(longer, k)
                matches.append((k, p, t))
        if longer:  # start again from the longest match seen
            length = longer
            continue
        for k, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            while k >= length and (any(in_item[p : p + k]) or any(in_doc[t : t + k])):
                k -= 1  # an earlier tile took the end; what is left of the match may still be long enough
            if k >= length:
                in_item[p : p + k] = [True] * k
                in_doc[t : t + k] = [True] * k
                tiles.append((p, t, k))
        if length == least:
            return tiles
        length = max(least, length // 2) if length > 2 * least else least


def _tiled(pairs: DataFrame) -> DataFrame:
    schema = (
        "row_id bigint, doc_id bigint, text_key string, item_id bigint, item_words int, covered int, n_tiles int, reordered boolean"
    )

    def rows(batch: pa.RecordBatch):
        sizes, covered, counts, moved = [], [], [], []
        for item, tokens, positions in zip(*[batch.column(c).to_pylist() for c in ("item", "tokens", "positions")]):
            tiles = sorted(tile(item, tokens, positions, min(SEED_WORDS, len(item))))
            sizes.append(len(item))
            covered.append(sum(k for _, _, k in tiles))
            counts.append(len(tiles))
            moved.append(any(a[1] > b[1] for a, b in zip(tiles, tiles[1:])))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("row_id", "doc_id", "text_key", "item_id")],
                pa.array(sizes, pa.int32()),
                pa.array(covered, pa.int32()),
                pa.array(counts, pa.int32()),
                pa.array(moved, pa.bool_()),
            ],
            names=["row_id", "doc_id", "text_key", "item_id", "item_words", "covered", "n_tiles", "reordered"],
        )

    return map_batches(pairs, schema, rows)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document row and benchmark item whose tokens it covers to ``coverage`` or more.

    Null and empty texts match nothing, nor do items without tokens; items of
    fewer than five tokens are one seed.  Repeated rows are reported each.
    """
    items, seeds = benchmark_items(benchmark)
    seeds = materialise(seeds, "seeds")
    lengths = sorted(r[0] for r in seeds.select("seed_words").distinct().collect())  # at most five values
    screened = materialise(_screen(docs, _bitmap(seeds), lengths), "screened")
    pairs = (
        screened.select("row_id", F.explode("hits").alias("seed"))
        .join(seeds.select("seed", "item_id"), "seed")
        .select("row_id", "item_id")
        .distinct()
    )
    work = pairs.join(items, "item_id").join(screened.drop("hits"), "row_id")
    share = F.col("covered") / F.col("item_words")
    return _tiled(work).withColumn("coverage", share).filter(F.col("coverage") >= coverage)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents that reproduce no benchmark item; the verdict goes by text, so it also holds without ids."""
    key = fresh_name(docs, "__text_key")
    found = matches(docs, benchmark, coverage).select(F.col("text_key").alias(key)).distinct()
    found = materialise(found, "contaminated")
    return docs.join(found, text_key() == F.col(key), "left_anti")
