"""Quality classifier by importance resampling.

Two bag models over hashed one- and two-grams, one of target text (labelled
good) and one of the raw corpus, give every document the log ratio of its
probability under both.  Adding seeded Gumbel noise and keeping the k largest
sums draws k documents without replacement in proportion to the ratios.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, map_batches, mix, word_hashes
from quillmesh.session import materialise

BUCKETS = 1 << 14
TARGET_ROWS = 20_000  # bound of the labelled sample the target model is fitted on
SHARE = 0.8
SMOOTHING = 1.0

_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]")


def grams(text: str | None) -> np.ndarray:
    """Buckets of the one- and two-grams of words and single symbols, in lower case."""
    if not text:
        return np.empty(0, np.int64)
    h = word_hashes(_TOKENS.findall(text.encode().lower()))
    pairs = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate((mix(h), pairs)) & U64(BUCKETS - 1)).astype(np.int64)


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    """Gram counts of all texts, summed per task before one row per bucket is left for the driver."""

    def rows(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(grams(t.as_py()), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = texts.mapInArrow(rows, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Log of target over raw probability per bucket.

    The raw model reads every document.  The target model reads the documents
    of at most ``target_rows`` good labels, those with the smallest hashes.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    sample = good.orderBy(F.xxhash64("__id"), "__id").limit(target_rows)
    target = docs.join(F.broadcast(sample), F.col("doc_id").cast("long") == F.col("__id"), "left_semi")
    t, r = (_bucket_counts(d.select("text")) + SMOOTHING for d in (target, docs))
    return np.log(t / t.sum()) - np.log(r / r.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """``doc_id, log_weight, noisy, key``; ``key`` orders like ``noisy`` as a long.

    Null and empty texts have weight 0.  The noise depends on the seed, the id
    and the text, so rows that repeat share it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def rows(batch: pa.RecordBatch):
        w = np.array([shared.value[grams(t.as_py())].sum() for t in batch.column(1)], dtype=np.float64)
        draw = mix(batch.column(2).to_numpy(zero_copy_only=False).view(U64))
        u = ((draw >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        noisy = w - np.log(-np.log(u))
        bits = noisy.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(w), pa.array(noisy), pa.array(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))],
            names=["doc_id", "log_weight", "noisy", "key"],
        )

    noise = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text"))
    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text", noise), "doc_id bigint, log_weight double, noisy double, key bigint", rows
    )


def threshold(weighted: DataFrame, k: int) -> int | None:
    """The k-th largest key, found 16 bits at a time: each pass brings at most 65,536 counts to the driver."""
    if k <= 0:
        return None
    prefix, left, rows = 0, k, weighted.select("key")
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift) if shift == 48 else F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
        for d, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return -(1 << 63)  # fewer than k rows
        prefix = prefix << 16 | d if shift < 48 else d
        rows = rows.filter(F.shiftright("key", shift) == prefix)
    return prefix


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 0) -> DataFrame:
    """``doc_id, log_weight, noisy, selected`` for every row.

    Selected are the ceil(share * rows) rows with the largest noisy weights;
    rows that tie with the last of them are selected too.
    """
    weighted = materialise(weigh(docs, log_ratios(docs, labels), seed), "weights")
    k = -int(-(share * weighted.count()) // 1)
    least = threshold(weighted, k)
    chosen = F.lit(False) if least is None else F.col("key") >= F.lit(least)
    return weighted.select("doc_id", "log_weight", "noisy", chosen.alias("selected"))
