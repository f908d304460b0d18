"""Operator 5: preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common turn prefix of the two conversations is rendered once as the
prompt; what follows becomes a pair of completions.  A completion's mask says, run
by run, which characters are to be learned: ``length:1`` for an assistant's text
and its end mark, ``length:0`` for all else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def header(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def mask(turns: Column, learned: str) -> Column:
    def runs(t: Column) -> Column:
        label = F.when(t["role"] == learned, F.lit(":1")).otherwise(F.lit(":0"))
        return F.concat(F.length(header(t)).cast("string"), F.lit(":0,"), F.length(body(t)).cast("string"), label)

    return F.array_join(F.transform(turns, runs), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns, from the first on, are the same in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, learned: str = "assistant") -> DataFrame:
    """One row for each pair: prompt, chosen and rejected completion, and their masks.

    ``turns`` has conv_id, turn, role, text; ``pair`` names the pair that a
    conversation belongs to and ``chosen`` is true for its better side.  Turns are
    taken by number, then role and text, so repeated rows stay and ties don't
    matter.  Null roles and texts count as empty; rows without a pair or a turn
    number belong to no conversation and are left out.  A side that is missing is
    an empty conversation: the prompt is then empty too.  Equal conversations are
    all prompt.  The two sides of a pair make one output row, so they meet in one
    task; nothing larger does.
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("better"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("better").isNotNull())
    side = lambda yes: F.sort_array(F.collect_list(F.when(F.col("better") == yes, F.struct("turn", "role", "text"))))
    pairs = rows.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    pairs = pairs.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    pairs = pairs.withColumns({"prompt_turns": F.slice("c", F.lit(1), F.col("n")), "c": rest("c"), "r": rest("r")})
    return pairs.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.col("prompt_turns")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        mask(F.col("c"), learned).alias("chosen_mask"),
        mask(F.col("r"), learned).alias("rejected_mask"),
    )
