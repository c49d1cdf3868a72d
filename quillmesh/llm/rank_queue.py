"""Byte-level BPE by ranks: a hierarchical-bitmap queue of merges, and decoding.

A vocabulary gives every byte string a rank, which is also its id.  Of all
neighbouring parts whose bytes together are in the vocabulary, the pair of the
least rank is merged first, the leftmost of equals, until none is left.

``RankQueue`` has a bucket per rank, which holds positions of a linked list of
parts, and a bitmap of two levels over the buckets: one find-first-set picks
the word, a second one the rank.  A merge changes the pairs on both of its
sides; their old entries stay behind and are skipped when their turn comes.
So a merge costs the same in a word of ten bytes and in one of ten million,
and many pre-tokens, kept apart by a byte that no text holds, share one queue.

Pre-tokens are the matches of ``public_tokenizers.PATTERN`` or of another
pattern, found in stretches of bounded length.
"""

from __future__ import annotations

import base64
import math
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import count, groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import fresh_name, map_batches

CHUNK = 1 << 18  # characters searched for pre-tokens at once
GROUP = 1 << 20  # characters whose new pre-tokens share a queue
MARGIN = 32  # a match that ends so far before the edge of a chunk is the same in the whole text
CACHE_WORDS = 1 << 18  # in each of two generations, about 50 MB each
CACHED_LENGTH = 48
DECODE_IDS = 1 << 16
APART = b"\xff"  # in no UTF-8 text, and in no token but its own

# Where Unicode versions agree on letters, numbers and blanks (as all do below
# U+0300, but for the separators x1C to x1F), the standard library finds the
# same matches faster.
PLAIN = re.compile("[^\x00-\x1b -˿]")
_NUMBER = "\\d²³¹¼½¾"
PLAIN_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[^\\W_{_NUMBER}]+| ?[{_NUMBER}]+| ?(?:[^\\w\\s]|_)+|\\s+(?!\\S)|\\s+"
)


@lru_cache(maxsize=1)
def newer_characters() -> dict[str, str]:
    """Letters and numbers of the ``regex`` module's Unicode tables that those of tiktoken do not know, as sets.

    Only characters that Python's own tables leave unassigned can differ; the
    library is asked about each of them.
    """
    octets = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    found = {}
    for kind in ("\\p{L}", "\\p{N}"):
        asked = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=octets | {b"aa": 256}, special_tokens={})
        newer = (c for c in regex.findall(kind, every) if unicodedata.category(c) == "Cn")
        unknown = [ord(c) for c in newer if not asked.encode_ordinary(c)]
        runs = [list(g) for _, g in groupby(unknown, lambda c, n=count(): c - next(n))]
        found[kind] = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)
    return found


@lru_cache(maxsize=4)
def as_library(pattern: str) -> regex.Pattern:
    """The pattern with letters and numbers as tiktoken knows them."""
    for kind, newer in newer_characters().items():
        if newer:
            pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
    return regex.compile(pattern, regex.V1)


class RankQueue:
    """Positions by rank; ``take`` returns the least rank and all its positions in order."""

    def __init__(self, ranks: int):
        self.width = max(1, math.isqrt(max(ranks - 1, 0)) + 1)
        self.top = 0
        self.words = [0] * self.width
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """Open the bucket of a rank that holds no positions."""
        self.buckets[rank] = positions
        word, bit = divmod(rank, self.width)
        self.words[word] |= 1 << bit
        self.top |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        rank = word * self.width + (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.words[word] = bits
        if not bits:
            self.top = top & (top - 1)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Ranks:
    """A vocabulary of byte strings and their ranks, read from a file of base64 and rank per line."""

    def __init__(self, path: str, pattern: str | None = None):
        lines = (line.split() for line in Path(path).read_bytes().splitlines())
        self.ranks = {base64.b64decode(parts[0]): int(parts[1]) for parts in lines if parts}
        if any(APART in token and len(token) > 1 for token in self.ranks):
            raise ValueError("a token of several bytes holds xFF, which keeps pre-tokens apart")
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.queue = RankQueue(self.size)
        self.own = pattern is not None and pattern != public_tokenizers.PATTERN
        self.pattern = pattern or public_tokenizers.PATTERN

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        if not pieces:
            return []
        data = APART.join(pieces) + APART
        octets = np.frombuffer(data, np.uint8)
        n, get, queue = len(data), self.ranks.get, self.queue
        token = self.bytes[octets].tolist()
        first = self.pairs[octets[:-1].astype(np.int64) << 8 | octets[1:]]
        live = [*first.tolist(), -1]  # rank of the pair that starts here, -1 for none
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        held, starts = np.unique(first[at], return_index=True)
        for rank, positions in zip(held.tolist(), np.split(at, starts[1:])):
            queue.put(rank, positions.tolist())
        put, take, bucket = queue.put, queue.take, queue.buckets.get
        while queue.top:
            rank, positions = take()
            lower = False
            for k, i in enumerate(positions):
                if live[i] != rank:
                    continue  # stale: one of its parts has gone into another merge
                j = after[i]
                end = after[j]
                token[i] = rank
                token[j] = live[j] = -1
                after[i] = end
                before[end] = i
                live[i] = found = get(data[i : after[end]], -1)
                if found >= 0:
                    lower = found < rank
                    if (held := bucket(found)) is None:
                        put(found, [i])
                    else:
                        held.append(i)
                if (h := before[i]) >= 0:
                    live[h] = found = get(data[h:end], -1)
                    if found >= 0:
                        lower |= found < rank
                        if (held := bucket(found)) is None:
                            put(found, [h])
                        else:
                            held.append(h)
                if lower:  # that one is next; the others wait
                    if k + 1 < len(positions):
                        put(rank, positions[k + 1 :])
                    break
        ids = np.array(token)
        ids[octets == 255] = -1  # the separators, which are no part of any piece
        kept = ids >= 0
        ends = np.cumsum([len(p) + 1 for p in pieces])
        cuts = 4 * np.concatenate([[0], np.cumsum(kept)[ends - 1]])
        packed = ids[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def _found(self, text: str, start: int, end: int) -> list[str]:
        if not self.own and PLAIN.search(text, start, end) is None:
            return PLAIN_PIECES.findall(text, start, end)
        return as_library(self.pattern).findall(text, start, end)

    def chunks(self, text: str):
        """Lists of pre-tokens, in order and together all of the text."""
        start, size, n = 0, CHUNK, len(text)
        while n - start > size:
            pieces = self._found(text, start, start + size)
            held = sum(map(len, pieces))
            if held != size:
                raise ValueError("the pattern leaves characters out")
            while pieces and held > size - MARGIN:
                held -= len(pieces.pop())
            if not pieces:  # one match fills the chunk
                size *= 2
                continue
            yield pieces
            start, size = start + held, CHUNK
        yield self._found(text, start, n)


class Words(dict):
    """Pre-token -> its ids.  Bounded: a full table becomes the older generation, from which words in use move back."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the table lacks; short ones are kept."""
        known, found, fresh = self.ranks.ranks, {}, []
        for piece in pieces:
            ids = self.older.get(piece)
            if ids is None:
                rank = known.get(piece.encode())
                if rank is None:
                    fresh.append(piece)
                    continue
                ids = rank.to_bytes(4, "little")
            found[piece] = ids
        found.update(zip(fresh, self.ranks.merge([p.encode() for p in fresh])))
        if len(self) + len(found) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self.update((p, ids) for p, ids in found.items() if len(p) <= CACHED_LENGTH)
        return found

    def encode(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of pre-tokens; what is new in any of them goes through one queue."""
        pieces = set().union(*lists)
        table = {p: self[p] for p in pieces if p in self}
        table.update(self.learn(pieces.difference(table)))
        return [b"".join(map(table.__getitem__, each)) for each in lists]


@lru_cache(maxsize=2)
def load(path: str, pattern: str | None = None) -> Words:
    return Words(Ranks(path, pattern))


def encode_texts(texts: list[str], words: Words) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    out: list[list[bytes]] = [[] for _ in texts]
    lists: list[list[str]] = []
    owners: list[int] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        for k, ids in zip(owners, words.encode(lists)):
            out[k].append(ids)
        lists.clear()
        owners.clear()
        waiting = 0

    for k, text in enumerate(texts):
        for pieces in words.ranks.chunks(text) if text else ():
            lists.append(pieces)
            owners.append(k)
            waiting += min(len(text), CHUNK)
            if waiting >= GROUP:
                flush()
    if lists:
        flush()
    return [b"".join(parts) for parts in out]


def _text(value: pa.Scalar) -> str:
    data = value.as_buffer()
    return data.to_pybytes().decode("utf-8", "replace") if data is not None else ""


def encode(
    docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), pattern: str | None = None, ids: str = "ids"
) -> DataFrame:
    """Per row the columns ``keep``, ``n_tokens`` and ``ids`` (array of int).

    Null and empty texts have no ids; rows that repeat stay; ill-formed UTF-8
    counts as U+FFFD.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name, row = Path(vocabulary).name, fresh_name(docs, "__keep")
    source = docs.select(F.struct(*keep).alias(row), F.col("text").cast("binary"))

    def rows(batch: pa.RecordBatch):
        words = load(SparkFiles.get(name), pattern)
        parts = encode_texts([_text(t) for t in batch.column(1)], words)
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        sizes = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, lists], names=[row, "n_tokens", ids])

    fields = source.schema[row].dataType.simpleString()
    return map_batches(source, f"{row} {fields}, n_tokens bigint, {ids} array<int>", rows).select(f"{row}.*", "n_tokens", ids)


def decode_ids(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """Bytes the ids stand for; ids that the vocabulary lacks stand for none."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
        ids = ids[(ids >= 0) & (ids < len(tokens))]
    blocks = (ids[k : k + DECODE_IDS].tolist() for k in range(0, len(ids), DECODE_IDS))
    return b"".join([b"".join(map(tokens.__getitem__, block)) for block in blocks])


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace the column ``ids`` by the bytes it stands for; null gives no bytes."""
    encoded.sparkSession.sparkContext.addFile(vocabulary)
    name, row = Path(vocabulary).name, fresh_name(encoded, "__keep")
    rest = [c for c in encoded.columns if c != ids]
    source = encoded.select(F.struct(*rest).alias(row), F.col(ids))

    def rows(batch: pa.RecordBatch):
        tokens = load(SparkFiles.get(name)).ranks.tokens
        lists = batch.column(1)
        values, offsets = lists.values.fill_null(-1).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        data = [decode_ids(values[a:b], tokens) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[row, out])

    fields = source.schema[row].dataType.simpleString()
    return map_batches(source, f"{row} {fields}, {out} binary", rows).select(f"{row}.*", out)
