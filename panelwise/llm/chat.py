"""Preference examples from pairs of conversations, in DataFrame expressions only.

The longest common turn prefix of the chosen and the rejected conversation is rendered once as the
prompt; what follows in each is its completion. A completion's mask lists the spans (code points,
end exclusive) of the assistant's turns, the only ones to learn from.

Turns meet their pair by one join on the conversation and are gathered into one row a pair, which is the
size of the example that is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNT = "assistant"


def rendered(turn: Column) -> Column:
    """One turn as text. A null role or text is empty; ``<|`` inside a text is spelled ``< |``."""
    body = F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), body, F.lit("\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column) -> Column:
    """``start:end`` of the learnt turns' text in the rendered completion, comma-joined."""

    def step(acc: Column, turn: Column) -> Column:
        whole = F.length(rendered(turn))
        head = F.length(F.coalesce(turn["role"], F.lit(""))) + 5  # <|role|> and a line end
        span = F.concat_ws(":", acc["at"] + head, acc["at"] + whole)
        own = F.when(turn["role"] == LEARNT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + whole).alias("at"), own.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with the same role and text."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask).

    ``turns`` has (conv_id, turn, role, text), ``pairs`` (pair_id, chosen_id, rejected_id). Turns go by
    number, then role, then text, nulls first; repeated turns count once. A conversation without
    turns has an empty completion; a pair is left out only if neither side has any. If one side is a
    prefix of the other its completion is empty. Other columns of ``turns`` don't matter.
    """
    sides = pairs.select(
        "pair_id", "chosen_id", "rejected_id",
        F.explode(F.array(F.struct(F.lit(True).alias("won"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(False).alias("won"), F.col("rejected_id").alias("conv_id")))).alias("side"),
    ).select("pair_id", "chosen_id", "rejected_id", "side.won", "side.conv_id")
    turn = F.struct("turn", "role", "text")
    both = turns.select("conv_id", turn.alias("t")).join(sides, "conv_id").groupBy("pair_id", "chosen_id", "rejected_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("won"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_set(F.when(~F.col("won"), F.col("t")))).alias("b"),
    )
    both = both.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.size(side))
    return both.select(
        "pair_id", "chosen_id", "rejected_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _text(F.slice(F.col("a"), F.lit(1), F.col("n"))).alias("prompt"),
        _text(rest("a")).alias("chosen"), _text(rest("b")).alias("rejected"),
        _mask(rest("a")).alias("chosen_mask"), _mask(rest("b")).alias("rejected_mask"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations with the numbers 2k and 2k + 1.

    The one whose assistant wrote more is chosen, of equals the one with the smaller number. Null numbers
    and conversations without a partner are left out.
    """
    own = turns.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").distinct()
    size = own.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == LEARNT, F.length("text")).otherwise(0)).alias("n"))
    pair = size.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).agg(
        F.count(F.lit(1)).alias("sides"),
        F.max_by("conv_id", F.struct(F.coalesce("n", F.lit(0)), -F.col("conv_id"))).alias("chosen_id"),
        F.min_by("conv_id", F.struct(F.coalesce("n", F.lit(0)), -F.col("conv_id"))).alias("rejected_id"),
    )
    return pair.where("sides = 2").drop("sides")
