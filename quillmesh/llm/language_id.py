"""Language ID by bit-sliced Bloom filters over letter trigrams.

One Bloom filter per language, stored as slices: slot s holds a bit per
language, so ANDing the k slots of a trigram returns at once every language
that contains it.  A text's trigrams are counted per language (popcounts per
slice); each count is corrected for the hits its filter would give by chance,
and the language with the largest corrected count wins.

The filters have a fixed number of slots whatever the corpus, so what the
driver gathers and broadcasts is bounded by ``SLOTS`` times the words that the
language bits need.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, map_batches, mix, signed
from quillmesh.session import materialise

SLOTS = 1 << 20
PROBES = 3
LEAST_COUNT = 2  # a trigram seen less often in a language is left out of its filter
DOMINANCE = 0.05  # ... as is one with under this share of its frequency in the language that uses it most
UNDETERMINED = "und"
WORD_BITS = 62


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str | None) -> np.ndarray | None:
    """Letter trigrams in order, runs of other characters being one blank; None if no letter occurs."""
    if not text:
        return None
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for the run
    keep[0] = True
    line = np.where(letter, points, 32)[keep].astype(U64)
    return line[:-2] << U64(42) | line[1:-1] << U64(21) | line[2:]


def _slots(grams: np.ndarray, k: int) -> np.ndarray:
    return (mix(grams + U64((k * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) & U64(SLOTS - 1)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    slices: np.ndarray  # (words, SLOTS) int64
    chance: np.ndarray  # false-positive rate per language

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, share of the trigrams it explains beyond chance); ties go to the first name."""
        grams = trigrams(text)
        if grams is None or not self.languages:
            return UNDETERMINED, 0.0
        distinct, times = np.unique(grams, return_counts=True)
        probes = [_slots(distinct, k) for k in range(PROBES)]
        hits = np.zeros(len(self.languages))
        for w, table in enumerate(self.slices):
            mask = table[probes[0]]
            for p in probes[1:]:
                mask = mask & table[p]
            for bit, _ in enumerate(self.languages[w * WORD_BITS : (w + 1) * WORD_BITS]):
                hits[w * WORD_BITS + bit] = times[(mask >> bit & 1).astype(bool)].sum()
        total = times.sum()
        corrected = (hits - total * self.chance) / np.maximum(1 - self.chance, 1e-9)
        best = int(np.argmax(corrected))
        return self.languages[best], float(min(max(corrected[best] / total, 0.0), 1.0))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> LanguageModel:
    """Learn from text and lang of every row with a known id that is not held out."""

    def rows(batch: pa.RecordBatch):
        found: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            grams = trigrams(text.as_py())
            if grams is not None:
                found.setdefault(lang, []).append(grams)
        for lang, parts in found.items():
            grams, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(signed(grams)), pa.array(times.astype(np.int64))],
                names=["lang", "gram", "n"],
            )

    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = map_batches(known.select("text", F.col("lang").cast("string")), "lang string, gram bigint, n bigint", rows)
    counts = materialise(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    words = max(1, -(-len(languages) // WORD_BITS))
    slices = np.zeros((words, SLOTS), dtype=np.int64)
    if languages:
        spark = docs.sparkSession
        names = spark.createDataFrame(
            [(name, k, float(totals[name])) for k, name in enumerate(languages)], "lang string, no int, total double"
        )
        rated = counts.join(names, "lang").withColumn("rate", F.col("n") / F.col("total"))
        peak = rated.groupBy("gram").agg(F.max("rate").alias("peak"))
        chosen = rated.join(peak, "gram").filter((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= DOMINANCE * F.col("peak")))
        _fill(slices, chosen.select("gram", "no"))
    bits = [(slices[k // WORD_BITS] >> (k % WORD_BITS) & 1).mean() for k in range(len(languages))]
    return LanguageModel(languages, slices, np.array(bits) ** PROBES)


def _fill(slices: np.ndarray, chosen: DataFrame) -> None:
    """Set the bits of (trigram, language) pairs, combined per slot before anything reaches the driver."""

    def rows(batch: pa.RecordBatch):
        grams = batch.column(0).to_numpy().view(U64)
        no = batch.column(1).to_numpy().astype(np.int64)
        for k in range(PROBES):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_slots(grams, k)),
                    pa.array((no // WORD_BITS).astype(np.int32)),
                    pa.array(np.int64(1) << (no % WORD_BITS)),
                ],
                names=["slot", "word", "bit"],
            )

    set_bits = map_batches(chosen, "slot bigint, word int, bit bigint", rows)
    found = set_bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    slices[found.column("word").to_numpy(), found.column("slot").to_numpy()] = found.column("bits").to_numpy()


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; reads the text alone.

    ``und`` with score 0 for a null text, a text without a letter, or a model
    that learned no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch):
        verdicts = [shared.value.decide(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([v[0] for v in verdicts], pa.string()),
                pa.array([v[1] for v in verdicts], pa.float64()),
            ],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"),
        "doc_id bigint, held_out boolean, lang_pred string, score double",
        rows,
    )
