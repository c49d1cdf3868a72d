"""Preference formatting of chosen and rejected conversations.

A pair is given as two conversations, each one row per turn.  The longest
common prefix of turns is found by comparing turns side by side, so a
conversation of any length is never gathered in one place; the prefix is
rendered once as prompt, what follows becomes the two completions.  Every
output row is one rendered turn with its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.ordering import dense_index
from quillmesh.session import materialise

TEMPLATE = ("<|", "|>\n", "<|end|>\n")  # role marks around a turn
TRAINED = "assistant"


def positions(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, nth, role, text``: ``nth`` tells rows with the same turn apart, by role and text.

    Null role and text count as empty; a turn without a number comes first; rows without a
    conversation id are left out, since they belong to none.
    """
    plain = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return plain.withColumn("nth", F.row_number().over(same))


def sibling_pairs(turns: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected``: neighbours, by id, among conversations that open with the same turn.

    Every conversation is in two pairs at most, however many share an opening.
    """
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    opening = turns.filter("nth = 1").join(first, ["conv_id", "turn"])
    keyed = opening.select(F.xxhash64("role", "text").alias("opening"), "conv_id")
    rows = dense_index(keyed, ["opening", "conv_id"], "place")
    after = rows.select((F.col("place") - 1).alias("place"), F.col("opening").alias("o2"), F.col("conv_id").alias("rejected"))
    return rows.join(after, "place").filter("opening = o2").select(
        F.concat(F.lit("s"), F.col("conv_id")).alias("pair_id"), F.col("conv_id").alias("chosen"), "rejected"
    )


def stale_reply_pairs(turns: DataFrame) -> DataFrame:
    """Both sides of pairs made of one conversation: rejected answers its last question with its first answer."""
    said = turns.filter(F.col("role") == TRAINED).groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    said = said.filter("first < last")
    reply = turns.join(said, "conv_id").filter("turn = first and nth = 1").select("conv_id", F.col("text").alias("stale"))
    rows = turns.join(said.join(reply, "conv_id").select("conv_id", "last", "stale"), "conv_id")
    text = F.when((F.col("turn") == F.col("last")) & (F.col("role") == TRAINED), F.col("stale")).otherwise(F.col("text"))
    pair = F.concat(F.lit("r"), F.col("conv_id")).alias("pair_id")
    chosen = rows.select(pair, F.lit("chosen").alias("side"), "turn", "nth", "role", "text")
    return chosen.union(rows.select(pair, F.lit("rejected"), "turn", "nth", "role", text))


def sides_of(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """``pair_id, side, turn, nth, role, text`` of pairs given by conversation ids."""
    out = [
        pairs.select("pair_id", F.col(side).alias("conv_id")).join(turns, "conv_id").select(
            "pair_id", F.lit(side).alias("side"), "turn", "nth", "role", "text"
        )
        for side in ("chosen", "rejected")
    ]
    return out[0].union(out[1])


def render(role: Column, text: Column) -> Column:
    head, mid, end = TEMPLATE
    return F.concat(F.lit(head), role, F.lit(mid), text, F.lit(end))


def format_pairs(sides: DataFrame) -> DataFrame:
    """``pair_id, part, turn, nth, rendered, trained``.

    ``part`` is prompt (the common prefix, once per pair), chosen or rejected.
    ``trained`` is the loss mask: true for assistant turns of a completion.
    Identical conversations have a prompt and no completion.
    """
    sides = materialise(sides, "sides")
    place = ["pair_id", "turn", "nth"]
    # one group per place of a pair, two rows at most: equal turns on both sides, or the place where they part
    at = sides.groupBy(*place).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("role", "text")).alias("low"), F.max(F.xxhash64("role", "text")).alias("high")
    )
    parting = (
        at.filter("n < 2 or low <> high")
        .groupBy("pair_id")
        .agg(F.min(F.struct("turn", "nth")).alias("parting"))
    )
    rows = sides.join(parting, "pair_id", "left")
    prompt = F.col("parting").isNull() | (F.struct("turn", "nth") < F.col("parting"))
    return rows.filter(~prompt | (F.col("side") == "chosen")).select(
        "pair_id",
        F.when(prompt, F.lit("prompt")).otherwise(F.col("side")).alias("part"),
        "turn",
        "nth",
        render(F.col("role"), F.col("text")).alias("rendered"),
        (~prompt & (F.col("role") == TRAINED)).alias("trained"),
    )
