"""Preference formatting: one prompt for the common turns of two conversations, and a masked completion for each.

Built-in functions only. Turns are gathered per conversation: a conversation becomes one output row, so its turns are the
unit of work; conversations are spread by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turns(side: DataFrame, pair: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    value = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return (side.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair"))
            .agg(F.transform(F.array_sort(F.collect_list(value)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _segments(turns: Column) -> Column:
    """Text pieces with the mask 1 on what the model has to learn: the text and end mark of trained turns."""
    return F.filter(F.flatten(F.transform(turns, lambda t: F.when(t["role"] == TRAINED_ROLE, F.array(
        F.struct(_head(t).alias("text"), F.lit(0).alias("mask")),
        F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), F.lit(1).alias("mask")))).otherwise(F.array(
            F.struct(F.concat(_head(t), t["text"], F.lit(CLOSE)).alias("text"), F.lit(0).alias("mask")))))), lambda s: s["text"] != "")


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """One row per pair on either side: pair_id, prefix_turns, prompt, chosen, rejected, chosen_segments, rejected_segments.

    The prompt is the longest prefix of turns with equal role and text, rendered once; the completions are the rest, as
    text and as (text, mask) segments. Turns order by turn number, then role and text, so repeated and equal numbers have
    one order. Null role or text is empty; a row without pair is left out; a pair on one side only has an empty other
    side and prefix.
    """
    both = (_turns(chosen, pair, turn, role, text, "a").join(_turns(rejected, pair, turn, role, text, "b"), "pair", "full")
            .select("pair", *(F.coalesce(c, F.array().cast("array<struct<role:string,text:string>>")).alias(c) for c in "ab")))
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    cut = F.when(differs > 0, differs - 1).otherwise(F.size("a")).cast("int")
    both = both.withColumn("cut", cut).select(
        "pair", F.col("cut").alias("prefix_turns"), F.slice("a", F.lit(1), F.col("cut")).alias("prompt"),
        *(F.slice(c, F.col("cut") + 1, F.size(c)).alias(c) for c in "ab"))
    return both.select(F.col("pair").alias(pair), "prefix_turns", _render(F.col("prompt")).alias("prompt"), _render(F.col("a")).alias("chosen"),
                       _render(F.col("b")).alias("rejected"), _segments(F.col("a")).alias("chosen_segments"),
                       _segments(F.col("b")).alias("rejected_segments"))


def with_substitute_reply(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns (pair_id, turn, role, text) out of logged conversations (conv_id, turn, role, text).

    Chosen is the conversation as it is. Rejected has, from its last trained turn on, that turn alone with the text of the
    last trained turn of the conversation numbered next to it (2k and 2k + 1 lend each other theirs; empty without one).
    A conversation without a trained turn is the same on both sides. Turns without a number stand first, stay on both
    sides and are not taken for a last turn.
    """
    turns = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = (turns.where((F.col("role") == TRAINED_ROLE) & F.col("turn").isNotNull()).groupBy("pair_id")
            .agg(F.max(F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("text"))).alias("last")))
    lent = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("last.text").alias("lent"))
    ends = last.select("pair_id", F.col("last.turn").alias("end")).join(lent, "pair_id", "left")
    swapped = ends.select("pair_id", F.col("end").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.coalesce("lent", F.lit("")).alias("text"))
    kept = turns.join(ends.select("pair_id", "end"), "pair_id", "left").where(F.col("end").isNull() | F.col("turn").isNull() | (F.col("turn") < F.col("end"))).drop("end")
    return turns, kept.unionByName(swapped)
