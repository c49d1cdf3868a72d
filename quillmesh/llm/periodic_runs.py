"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length of at least max(``least``, 2 q) that no neighbouring
word extends keeping period q.

Splitting.  Each word of a run stands in it twice at least, since the run holds
two whole periods.  A word that occurs once in a segment is therefore in no run
of it and splits it; its parts are segments of their own, in which other words
may now be alone.  A segment is searched from both ends at once, so a split
costs as many steps as its smaller part has words, n log n in all.

Scan.  A segment in which every word recurs is scanned by lags.  Lags below 8
are compared word by word.  A run of a lag between 2^k and 2^(k+1) has equal
words at that lag over 2^k positions in a row, thus over three blocks in a row
of a grid of 2^(k-2) words, whatever its place: block hashes select the lags
and places that can hold a run, and comparing words from there settles it.  A
band of lags costs a few comparisons per word, and there are log n bands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, fresh_name, map_batches, mix

LEAST = 12
DIRECT = 8  # lags below this are compared word by word
CELLS = 1 << 20  # cells of the block comparison held at once

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [low, high) of at least ``least`` words in which every word recurs."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    alone = np.flatnonzero((before < 0) & (after >= n))
    edges = np.concatenate([[-1], alone, [n]])
    wide = np.flatnonzero(np.diff(edges) > least)
    waiting = [(int(edges[k]) + 1, int(edges[k + 1])) for k in wide]
    if not waiting:
        return []
    before, after, found = before.tolist(), after.tolist(), []
    while waiting:
        low, high = waiting.pop()
        left, right = low, high - 1
        while left <= right:
            if before[left] < low and after[left] >= high:
                cut = left
                break
            if before[right] < low and after[right] >= high:
                cut = right
                break
            left += 1
            right -= 1
        else:
            found.append((low, high))
            continue
        if cut - low >= least:
            waiting.append((low, cut))
        if high - cut - 1 >= least:
            waiting.append((cut + 1, high))
    return found


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches [start, end) of true values of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    starts, ends = edges[::2], edges[1::2]
    wide = ends - starts >= least
    return list(zip(starts[wide].tolist(), ends[wide].tolist()))


def _reach(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Maximal stretch [start, end) around ``at`` in which words ``lag`` apart are equal."""
    n, end, step = len(ids) - lag, at, 64
    while end < n:
        stop = min(n, end + step)
        wrong = np.flatnonzero(ids[end:stop] != ids[end + lag : stop + lag])
        if len(wrong):
            end += int(wrong[0])
            break
        end, step = stop, 2 * step
    start, step = at, 64
    while start > 0:
        stop = max(0, start - step)
        wrong = np.flatnonzero(ids[stop:start] != ids[stop + lag : start + lag])
        if len(wrong):
            start = stop + int(wrong[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def _smallest(root: np.ndarray) -> bool:
    """Whether no shorter word repeated gives ``root``."""
    q = rest = len(root)
    prime = 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            while rest % prime == 0:
                rest //= prime
            p = q // prime
            if (root[p:] == root[:-p]).all():
                return False
        prime += 1
    return True


def scan(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of one segment as (start, length, period)."""
    n = len(ids)
    runs: list[tuple[int, int, int]] = []
    owner = np.full(n, -1)  # per word, the first run found that holds it

    def note(start: int, end: int, lag: int) -> None:
        if end - start + lag >= max(least, 2 * lag) and _smallest(ids[start : start + lag]):
            held = owner[start : end + lag]
            held[held < 0] = len(runs)
            runs.append((start, end - start + lag, lag))

    for lag in range(1, min(DIRECT, n // 2 + 1)):
        for start, end in _stretches(ids[lag:] == ids[:-lag], max(least - lag, lag)):
            note(start, end, lag)
    block, names = 2, mix(ids.astype(U64))
    names = names[:-1] * U64(0x9E3779B97F4A7C15) + np.roll(mix(names), -1)[:-1] if n > 1 else names
    names = mix(names)  # one per pair of neighbours
    while 4 * block <= n // 2:
        low, high = 4 * block, min(8 * block, n // 2 + 1)
        at = np.arange(0, len(names), block)
        padded = np.concatenate([names, np.zeros(high, U64)])
        lags = np.arange(low, high)
        there = np.ones(len(padded), bool)
        there[len(names) :] = False
        width = max(1, CELLS // max(1, len(at)))
        for first in range(0, len(lags), width):
            some = lags[first : first + width]
            far = at[:, None] + some
            equal = (padded[far] == names[at][:, None]) & there[far]
            rows, columns = np.nonzero(equal[:-2] & equal[1:-1] & equal[2:])
            places, shifts = at[rows], some[columns]
            # inside a run already found, a multiple of its period is no new one
            known = owner[places]
            inside = (known >= 0) & (known == owner[places + shifts])
            if inside.any():
                periods = np.array([r[2] for r in runs])
                inside[inside] = shifts[inside] % periods[known[inside]] == 0
            places, shifts = places[~inside], shifts[~inside]
            done: dict[int, int] = {}
            for place, lag in zip(places.tolist(), shifts.tolist()):
                if place < done.get(lag, 0):
                    continue
                start, end = _reach(ids, place, lag)
                done[lag] = end
                note(start, end, lag)
        block *= 2
        if len(names) <= block // 2:
            break
        half = block // 2
        names = mix(names[:-half] * U64(0x9E3779B97F4A7C15) + mix(names[half:]))
    return runs


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start, then period."""
    found = [
        (low + start, length, period)
        for low, high in segments(ids, least)
        for start, length, period in scan(ids[low:high], least)
    ]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for a word that some run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, collapsed: str = "collapsed") -> DataFrame:
    """Per row the columns ``keep``, ``n_words``, ``runs`` (start, length, period) and the text without repetitions.

    ``collapsed`` joins by one blank the words that no run holds after its
    first period.  Null and blank texts have no words, no runs and an empty
    ``collapsed``; rows that repeat stay.
    """
    row = fresh_name(docs, "__keep")
    source = docs.select(F.struct(*keep).alias(row), F.col("text").cast("binary"))

    def rows(batch: pa.RecordBatch):
        sizes, runs, texts = [], [], []
        for value in batch.column(1):
            words = (value.as_py() or b"").split()
            found = runs_of(numbered(words), least) if len(words) >= least else []
            if found:
                kept = kept_words(len(words), found)
                words_kept = [words[k] for k in np.flatnonzero(kept).tolist()]
            else:
                words_kept = words
            sizes.append(len(words))
            runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
            texts.append(b" ".join(words_kept))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[row, "n_words", "runs", collapsed])

    fields = source.schema[row].dataType.simpleString()
    return map_batches(source, f"{row} {fields}, n_words bigint, runs {RUNS}, {collapsed} binary", rows).select(
        f"{row}.*", "n_words", "runs", F.col(collapsed).cast("string").alias(collapsed)
    )


def digests(found: DataFrame, collapsed: str = "collapsed") -> DataFrame:
    """Replace ``runs`` and the text by their counts, the longest run and SHA-256 digests.

    Of the longest runs the one of the smallest start, then period, counts; a
    row without runs has nulls for it and digests of empty or whole texts.
    """
    # the greatest of (length, -start, -period)
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("a"), (-r["start"]).alias("b"), (-r["period"]).alias("c")))
    )
    line = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))),
        "",
    )
    others = [c for c in found.columns if c not in ("runs", collapsed)]
    top = fresh_name(found, "__best")
    return found.withColumn(top, best).select(
        *others,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col(f"{top}.b")).alias("start"),
        F.col(f"{top}.a").alias("length"),
        (-F.col(f"{top}.c")).alias("period"),
        F.floor(1000 * F.col(f"{top}.a") / -F.col(f"{top}.c")).cast("long").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2(collapsed, 256).alias("collapsed_sha256"),
    )
