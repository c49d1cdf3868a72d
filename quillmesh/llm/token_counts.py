"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at
each character; dynamic programming carries, per position, the best score and
the number of pieces on the best path.  Ties go, as in the tokenizer library,
to the piece that starts earliest; a character that no single-character piece
covers may be an unknown piece, and unknown stretches count as the bytes they
fall back to.  Sums are exact: scores are added as doubles in text order per
stretch between word starts, which no piece crosses.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_STRETCHES = 300_000
CACHED_LENGTH = 48

_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a model file; control, unknown and byte pieces are left out."""
    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(p.vocab_size())
    return [(p.id_to_piece(i), p.get_score(i)) for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


class CountingViterbi:
    """Counts for any vocabulary in which a blank mark only leads pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.tree = ahocorasick.Automaton()
        for piece, score in pieces:
            self.tree.add_word(piece, (len(piece), score))
        if pieces:
            self.tree.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece holds a blank mark after other characters")
        self.known: dict[str, tuple[int, float]] = {}

    def stretch(self, s: str) -> tuple[int, float]:
        """(pieces, score) of one stretch; unknown characters count their UTF-8 bytes."""
        n = len(s)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        at = 0
        hits = self.tree.iter(s) if self.single or len(self.tree) else iter(())
        hit = next(hits, None)
        for at in range(n):
            stop = at + 1
            # matches that end here come longest first, that is by ascending start
            while hit is not None and hit[0] == at:
                size, score = hit[1]
                before = best[stop - size]
                if before is not None and (best[stop] is None or before + score > best[stop]):
                    best[stop], count[stop] = before + score, count[stop - size] + 1
                hit = next(hits, None)
            if s[at] not in self.single and best[at] is not None:
                score = best[at] + self.unknown
                if best[stop] is None or score > best[stop]:
                    best[stop], count[stop] = score, count[at] + len(s[at].encode())
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a text with a leading blank mark; (0, 0) for null or empty."""
        if not text:
            return 0, 0.0
        pieces, score, known = 0, 0.0, self.known
        for m in _STRETCH.finditer(SPACE + text.replace(" ", SPACE)):
            s = m[0]
            found = known.get(s)
            if found is None:
                found = self.stretch(s)
                if len(s) <= CACHED_LENGTH:
                    if len(known) >= CACHE_STRETCHES:
                        known.clear()
                    known[s] = found
            pieces += found[0]
            score += found[1]
        return pieces, score


@lru_cache(maxsize=2)
def _counter(path: str) -> CountingViterbi:
    return CountingViterbi(vocabulary(path))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, best_score, n_chars`` per row.

    Null and empty texts have 0 tokens and score 0; repeated rows stay.
    """
    docs.sparkSession.sparkContext.addFile(model_file)
    name = Path(model_file).name

    def rows(batch: pa.RecordBatch):
        counter = _counter(SparkFiles.get(name))
        found, sizes = [], []
        for t in batch.column(1):
            text = t.as_py()
            found.append(counter.text(text))
            sizes.append(len(text or ""))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array(sizes, pa.int64()),
            ],
            names=["doc_id", "n_tokens", "best_score", "n_chars"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"), "doc_id bigint, n_tokens bigint, best_score double, n_chars bigint", rows
    )
