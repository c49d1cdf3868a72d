"""BPE as a streaming transducer with bounded lookahead, and incremental decoding.

Encoding.  Whether a token boundary of a word is final depends on a bounded
stretch of text to its right: a boundary is crossed only by a merge whose left
part ends there, and whether that merge happens depends on the boundary at the
end of its right part, under merges of a higher priority only.  ``lookahead``
follows these chains through the merge list and returns the longest one, a
sufficient lookahead L.  The transducer fills a window, merges inside it, emits
the tokens that end L or more symbols before its edge and slides on, so a word
of any length needs constant memory.  Words that fit the window are one step,
and a bounded table remembers them.

Decoding.  Token ids become bytes, bytes become text through an incremental
UTF-8 state machine that carries unfinished characters from block to block.

The tokenizer file (vocabulary, merge list, normaliser, pre-tokeniser) is a
parameter.  Supported: BPE with an end-of-word suffix over byte-level symbols,
with NFC, white space and lower case normalised and white space dropped.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from bisect import bisect_left
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm.common import fresh_name, map_batches, worker_table

BLOCK = 1 << 15  # characters normalised at once
CACHE_WORDS = 1 << 16  # in each of two generations; about 25 MB in all, whatever the vocabulary of the corpus
CACHED_LENGTH = 48
DECODE_IDS = 1 << 14
NO_MERGE, ID_MASK = 1 << 62, (1 << 32) - 1

# Below U+0300 NFC changes nothing and Unicode versions agree on letters, numbers
# and blanks (but for the separators x1C to x1F); blocks with other characters
# take the tokenizer file's own rules.
SIMPLE = re.compile("[^\x00-\x1b -\u02ff]")
_NUMBER = "\\d²³¹¼½¾"
PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)|[^\\W_{_NUMBER}]+|[{_NUMBER}]|(?:[^\\w\\s]|_)+")


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeList:
    """Vocabulary and merges as integers: ``ranks[left << 32 | right] = rank << 32 | merged id``."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ranks: dict[int, int] = {}
        self.parts: dict[int, list[tuple[int, int, int]]] = {}  # merged id -> (rank, left, right)
        self.rules: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.ranks.setdefault(a << 32 | b, rank << 32 | c)
            self.parts.setdefault(c, []).append((rank, a, b))
            self.rules.append((a, b, c))
        symbols = byte_symbols()
        self.inner = [self.ids[symbols[b]] for b in range(256)]
        self.last = [self.ids[symbols[b] + self.suffix] for b in range(256)]
        self.sizes = {i: len(t.removesuffix(self.suffix)) or len(t) for t, i in self.ids.items()}
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.pieces = [n.encode() for n in self.names]
        back = {s: b for b, s in symbols.items()}
        end = set(self.special.values())
        self.raw = [
            n.encode()
            if i in end
            else bytes(back[c] for c in n.removesuffix(self.suffix)) + b" " * bool(self.suffix and n.endswith(self.suffix))
            for i, n in enumerate(self.names)
        ]
        self.lookahead = self._sufficient_lookahead()
        del self.parts, self.rules  # only the lookahead needs them
        self.window = 2 * (self.lookahead + max(self.sizes.values())) + 2

    def _sufficient_lookahead(self) -> int:
        """Longest stretch right of a boundary that can decide whether a merge crosses it."""
        reach: dict[int, tuple[list[int], list[int]]] = {}  # left part -> ranks, running max of the stretch

        def crossing(token: int, below: int) -> int:
            """Stretch needed for the boundary right of ``token`` under merges ranked before ``below``."""
            ranks, most = reach.get(token, ((), ()))
            at = bisect_left(ranks, below)
            best = most[at - 1] if at else 0
            for rank, _, right in self.parts.get(token, ()):
                if rank < below:
                    best = max(best, crossing(right, rank))
                else:
                    best = max(best, crossing(right, below))
            return best

        for rank, (a, b, _) in enumerate(self.rules):
            need = self.sizes[b] + crossing(b, rank)
            ranks, most = reach.setdefault(a, ([], []))
            ranks.append(rank)
            most.append(max(need, most[-1] if most else 0))
        tokens = {t for rule in self.rules for t in rule}
        return max((crossing(t, len(self.rules)) for t in tokens), default=0)

    def merge(self, tokens: list[int]) -> list[int]:
        """Merge the pair of the least rank, leftmost first, until none is left."""
        get = self.ranks.get
        found = [get(a << 32 | b, NO_MERGE) for a, b in zip(tokens, tokens[1:])]
        while found and (best := min(found)) != NO_MERGE:
            i = found.index(best)
            tokens[i : i + 2] = [best & ID_MASK]
            del found[i]
            if i < len(found):
                found[i] = get(tokens[i] << 32 | tokens[i + 1], NO_MERGE)
            if i:
                found[i - 1] = get(tokens[i - 1] << 32 | tokens[i], NO_MERGE)
        return tokens

    def word(self, data: bytes) -> list[int]:
        """Tokens of one word.  Only a window of it is held as symbols at any time."""
        n = len(data)
        if n <= self.window:
            return self.merge([*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]])
        out: list[int] = []
        start = 0
        while start < n:
            end = min(n, start + self.window)
            tokens = [*map(self.inner.__getitem__, data[start:end])]
            if end == n:
                tokens[-1] = self.last[data[-1]]
            stable = n if end == n else end - self.lookahead
            for t in self.merge(tokens):
                if start + self.sizes[t] > stable:
                    break
                out.append(t)
                start += self.sizes[t]
        return out


@worker_table
def load(path: str) -> MergeList:
    return MergeList(path)


@worker_table
def _file_rules(path: str):
    own = Tokenizer.from_file(path)
    return own.normalizer, own.pre_tokenizer


class _Words(dict):
    """Blank-delimited word -> ids of its pieces as little-endian bytes.

    Bounded: a full table becomes the older generation, from which words in use move back.
    """

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges, self.older = merges, {}
        self.bytes_of = {s: b for b, s in byte_symbols().items()}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            known, pieces = self.get, PIECES.findall(word)
            ids = b"".join([known(piece) or self.pack(piece.encode()) for piece in pieces])
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def pack(self, data: bytes) -> bytes:
        return array("I", self.merges.word(data)).tobytes()


@worker_table
def _words(path: str) -> _Words:
    return _Words(load(path))


def _blocks(text: str):
    """Parts of a text that can be normalised and cut into words apart from each other.

    A part ends before a blank or, in a stretch without blanks, never: such a
    stretch is one word or more, and only its symbols are windowed.
    """
    start, n = 0, len(text)
    while n - start > BLOCK:
        cut = text.find(" ", start + BLOCK)
        line = text.find("\n", start + BLOCK, cut if cut >= 0 else n)
        cut = line if line >= 0 else cut
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _encode_plain(text: str, path: str, words: _Words):
    for block in _blocks(text):
        if SIMPLE.search(block) is None:
            yield b"".join(map(words.__getitem__, block.lower().split()))
        else:
            normal, cut = _file_rules(path)
            back = words.bytes_of
            for piece, _ in cut.pre_tokenize_str(normal.normalize_str(block)):
                yield words.pack(bytes(map(back.__getitem__, piece)))


def encode_text(text: str | None, path: str, words: _Words | None = None) -> bytes:
    """Ids of a text as little-endian 32-bit integers; strings of special tokens become those tokens."""
    if not text:
        return b""
    words = words or _words(path)
    special = words.merges.special
    out: list[bytes] = []
    rest = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special and any(s in text for s in special) else [text]
    for part in rest:
        if part in special:
            out.append(special[part].to_bytes(4, "little"))
        elif part:
            out.extend(_encode_plain(part, path, words))
    return b"".join(out)


class Decoder:
    """Ids in, text out, in blocks of any size.

    ``pieces``: token strings with a blank between them, as the library decodes
    a file without decoder.  ``text``: the bytes the tokens stand for, a blank
    after each word.  An ill-formed or unfinished character becomes U+FFFD.
    """

    def __init__(self, merges: MergeList, form: str = "pieces"):
        self.form = form
        self.table = merges.pieces if form == "pieces" else merges.raw
        self.gap = b" " if form == "pieces" else b""
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids) -> str:
        if not len(ids):
            return ""
        data = self.gap.join(map(self.table.__getitem__, ids))
        if not self.first:
            data = self.gap + data
        self.first = False
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", final=True)


def decode_ids(data: bytes, merges: MergeList, form: str = "pieces") -> str:
    machine, ids = Decoder(merges, form), memoryview(data).cast("I")
    parts = [machine.feed(ids[k : k + DECODE_IDS]) for k in range(0, len(ids), DECODE_IDS)]
    return "".join(parts) + machine.end()


def _shipped(df: DataFrame, tokenizer: str) -> str:
    """Send the tokenizer file to every executor once; tasks find it by name."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    return Path(tokenizer).name


def encode(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Per row the columns ``keep``, ``n_tokens`` and ``ids`` (little-endian 32-bit integers as binary).

    Null text counts as empty and gives no ids; rows that repeat stay.
    """
    name = _shipped(docs, tokenizer)
    row = fresh_name(docs, "__keep")
    source = docs.select(F.struct(*keep).alias(row), "text")

    def rows(batch: pa.RecordBatch):
        path = SparkFiles.get(name)
        words = _words(path)
        # one text at a time into a growing column: no second copy of a batch in Python objects
        data = pa.array([encode_text(t.as_py(), path, words) for t in batch.column(1)], pa.large_binary())
        data = data.cast(pa.binary())
        sizes = pa.array([len(d.as_buffer()) // 4 for d in data], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, data], names=[row, "n_tokens", ids])

    fields = source.schema[row].dataType.simpleString()
    return map_batches(source, f"{row} {fields}, n_tokens bigint, {ids} binary", rows).select(f"{row}.*", "n_tokens", ids)


def decode(encoded: DataFrame, tokenizer: str, form: str = "pieces", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace the column ``ids`` by the decoded text; null ids decode to an empty text."""
    name = _shipped(encoded, tokenizer)
    rest = [c for c in encoded.columns if c != ids]
    row = fresh_name(encoded, "__keep")
    source = encoded.select(F.struct(*rest).alias(row), F.col(ids))

    def rows(batch: pa.RecordBatch):
        merges = load(SparkFiles.get(name))
        texts = [decode_ids(d.as_py() or b"", merges, form) for d in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[row, out])

    fields = source.schema[row].dataType.simpleString()
    return map_batches(source, f"{row} {fields}, {out} string", rows).select(f"{row}.*", out)
