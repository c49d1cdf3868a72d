"""License scans: an Aho-Corasick pass over words, and a shunting-yard parser for license expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import alnum_words, map_batches

# Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases that only add labels.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by 4 0": "cc-by-4.0",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "isc license": "isc",
}
TAG = "spdx license identifier"
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}

_TAG_LINE = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+)")
_OPERATOR = {"and": "AND", "or": "OR", "with": "WITH"}

PHRASE_WEIGHT, TAG_WEIGHT = 0.6, 0.9


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def to_postfix(expression: str) -> list[str] | None:
    """Postfix form of the longest well-formed expression ``expression`` starts with; None without one."""
    best, out, stack = None, [], []
    at, operand_next = 0, True
    while m := _TOKEN.match(expression, at):
        at, token = m.end(), m[1]
        operator = _OPERATOR.get(token.lower())
        if operand_next:
            if token == "(":
                stack.append(token)
                continue
            if token == ")" or operator:
                break
            out.append(token)
            operand_next = False
        elif operator:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[operator]:
                out.append(stack.pop())
            stack.append(operator)
            operand_next = True
            continue
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
        if "(" not in stack:  # what has been read so far is an expression of its own
            best = out + stack[::-1]
    return best


def evaluate(postfix: list[str], allowed: frozenset[str] = frozenset()) -> tuple[frozenset[str], bool]:
    """(labels the expression names, whether ``allowed`` licences satisfy it).

    ``a WITH e`` is named ``a-with-e`` and satisfied when either that name or
    ``a`` is allowed, since an exception only adds permissions.
    """
    stack: list[tuple[frozenset[str], bool]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            name = token.lower()
            stack.append((frozenset([name]), name in allowed))
            continue
        (right, ok_right), (left, ok_left) = stack.pop(), stack.pop()
        if token == "WITH":
            names = frozenset(f"{a}-with-{b}" for a in left for b in right)
            stack.append((names, ok_left or bool(names & allowed)))
        else:
            stack.append((left | right, (ok_left and ok_right) if token == "AND" else (ok_left or ok_right)))
    return stack.pop()


def scan_text(text: str | None, allowed: frozenset[str] = frozenset()) -> dict:
    """Places and labels of one text; null counts as empty."""
    words = alnum_words(text)
    line = " " + b" ".join(words).decode("latin-1") + " "
    places, labels, tags = [], set(), []
    base, expressions, satisfied = set(), [], None
    for end, phrase in _automaton().iter(line):
        start = end - len(phrase) - 1
        if phrase in BASE:
            places.append(line.count(" ", 0, start))
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        if phrase == TAG:
            tags.append(start)
    if tags:
        for m in _TAG_LINE.finditer(text):
            if postfix := to_postfix(m[1]):
                names, ok = evaluate(postfix, allowed)
                labels |= names
                expressions.append(" ".join(postfix))
                satisfied = ok if satisfied is None else satisfied and ok
    phrases = len(base | labels) - (1 if expressions else 0)
    score = 1 - (1 - PHRASE_WEIGHT) ** max(phrases, 0) * (1 - TAG_WEIGHT) ** len(expressions)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)),
        "score": score,
        "expressions": expressions,
        "satisfied": satisfied,
    }


def scan(docs: DataFrame, allowed: frozenset[str] = frozenset()) -> DataFrame:
    """``doc_id`` and the findings of :func:`scan_text`, one row per row.

    ``expressions`` holds each tagged expression in postfix form; ``satisfied``
    says whether ``allowed`` meets all of them (null without an expression).
    Null and empty texts have no words, no labels and score 0.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.string()),
            ("labels", pa.string()),
            ("score", pa.float64()),
            ("expressions", pa.list_(pa.string())),
            ("satisfied", pa.bool_()),
        ]
    )

    def rows(batch: pa.RecordBatch):
        found = [scan_text(t.as_py(), allowed) for t in batch.column(1)]
        columns = [batch.column(0)] + [pa.array([f[n] for f in found], schema.field(n).type) for n in schema.names[1:]]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
        " labels string, score double, expressions array<string>, satisfied boolean",
        rows,
    )
