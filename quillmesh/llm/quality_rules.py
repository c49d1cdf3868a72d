"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once per document and stores one failure bit
per rule beside the measurements.  A policy is a named, versioned set of rules;
``apply_policy`` keeps a document when none of the policy's bits is set, and
``ablations`` answers "what if this rule were dropped" for all rules in one
aggregation over the stored bits, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import fresh_name

BLANKS = " \t\n\x0b\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
)

# Rule name -> condition over the measurements under which the rule fails.  The
# position of a rule is its bit for good: new rules are appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "2 * n_upper > n_letters",
    "few_letters": "2 * n_letters < word_chars",
}
BASE = ("few_words", "repeated_windows")

# Versioned policies; a published one is never changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def policy_mask(rules: Iterable[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash within one text.  Texts without a
    repeated window, the great majority, pay for one hash set only; the others
    sort their windows by (hash, position).
    """
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def neighbours(ordered: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))
        return F.filter(ordered, lambda e, k: same(e, k - 1) | same(e, k + 1))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = F.sort_array(F.transform(_let(pairs, neighbours), lambda e: e["i"]))
        total = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        )
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total["n"]).otherwise(F.lit(0))

    return F.when(n >= 4, _let(windows, covered)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements to every row.

    A null text measures like an empty one.  Columns of ``docs`` that carry the
    name of a measurement are replaced by it; rows are never merged or dropped,
    whatever they repeat.
    """
    own = [c for c in docs.columns if c.lower() not in {*MEASURES, "rule_mask"}]
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    own_body, own_words, own_lines = (fresh_name(docs, n) for n in ("__body", "__words", "__lines"))
    step = docs.select(
        *own,
        body.alias(own_body),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)).alias(own_words),
        F.filter(F.split(body, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias(own_lines),
    )
    n = F.size(own_words)
    measured = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(own_words, "")).cast("long").alias("word_chars"),
        F.regexp_count(own_body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(own_lines) - F.size(F.array_distinct(own_lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(own_words), n).alias("n_repeat_words"),
        F.size(own_lines).cast("long").alias("n_lines"),
        F.regexp_count(own_body, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(own_body, "\\P{L}+", "")).cast("long").alias("n_letters"),
    )
    # inline of one row keeps a later filter on the measurements from being pushed into them
    return step.select(*own, F.inline(F.array(measured)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements plus ``rule_mask``: bit r is set when rule r fails."""
    bits = [F.when(F.expr(rule), 1 << k).otherwise(0).cast("long") for k, rule in enumerate(RULES.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measure(docs, text).withColumn("rule_mask", mask)


def apply_policy(ledgered: DataFrame, version: str = "v2", kept: str = "kept") -> DataFrame:
    """Add the verdict of one policy; reads stored bits only."""
    mask = policy_mask(POLICIES[version])
    return ledgered.withColumn(kept, F.col("rule_mask").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(ledgered: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of a policy: documents failing it, failing nothing else, and kept without it.

    One aggregate over the stored bits, whatever the number of rules.  An empty
    ledger gives zeros.
    """
    names, mask = list(RULES), policy_mask(POLICIES[version])
    used = F.col("rule_mask").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(used == 0).alias("kept")]
    for rule in POLICIES[version]:
        bit = 1 << names.index(rule)
        sums.append(F.count_if(used.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"f_{rule}"))
        sums.append(F.count_if(used == bit).alias(f"o_{rule}"))
    rows = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.col(f"f_{rule}").alias("failed"),
            F.col(f"o_{rule}").alias("failed_alone"),
            F.col("kept").alias("kept_with"),
            (F.col("kept") + F.col(f"o_{rule}")).alias("kept_without"),
            F.col("n").alias("documents"),
        )
        for rule in POLICIES[version]
    ]
    return ledgered.agg(*sums).select(F.inline(F.array(*rows)))
