"""Preference formatting: one prompt for a chosen and a rejected conversation, and both masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is rendered: opening, role, break, text, closing.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
SIDES = ("chosen", "rejected")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BREAK), turn["text"], F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _masked(turns: Column) -> Column:
    """The pieces of a completion, each with whether it is trained on: the text and the closing of the assistant's turns."""

    def pieces(turn: Column) -> Column:
        head = F.concat(F.lit(OPEN), turn["role"], F.lit(BREAK))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("train")), F.struct(F.concat(turn["text"], F.lit(CLOSE)).alias("text"), (turn["role"] == TRAINED).alias("train")))

    return F.flatten(F.transform(turns, pieces))


def one_turn() -> Column:
    """A turn as it stands in a side; a null role or text is empty."""
    return F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """A gathered pair for every conversation: chosen as it is, rejected with a foreign last reply.

    conversations: conv_id, turn, role, text. The rejected side has the conversation's turns before
    its last one by the assistant, and then the last one by the assistant of its neighbour, the
    conversation whose id differs in the lowest bit. Conversations without a reply, a neighbour's
    reply or an id have an empty rejected side, or one that ends before the reply. Of repeated rows
    all count.

    One shuffle brings a conversation and its neighbour together; each text goes through it once.
    """
    couple = F.shiftright(F.col("conv_id").cast("long"), 1)
    turns = conversations.select(F.col("conv_id"), couple.alias("couple"), one_turn().alias("one")).repartition("couple")
    chosen = turns.groupBy("couple", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("chosen"))
    said = F.filter("chosen", lambda turn: turn["role"] == TRAINED)
    told = chosen.withColumn("last", F.array_max(F.transform(said, lambda turn: turn["turn"])))
    last = F.col("last")
    told = told.withColumn("replies", F.filter("chosen", lambda turn: (turn["role"] == TRAINED) & (turn["turn"] == last)))
    # A couple is two conversations at most: what stands before one or after it is the other.
    both = Window.partitionBy("couple").orderBy("conv_id")
    beside = F.when(F.col("couple").isNotNull(), F.coalesce(F.lag("replies").over(both), F.lead("replies").over(both)))
    foreign = told.withColumn("foreign", F.coalesce(beside, F.filter("chosen", lambda turn: F.lit(False))))
    none = F.filter("chosen", lambda turn: F.lit(False))
    before = F.filter("chosen", lambda turn: turn["turn"] < last)
    moved = F.transform("foreign", lambda turn: F.struct(last.alias("turn"), turn["role"], turn["text"]))
    rejected = F.when(F.col("couple").isNotNull() & F.exists("chosen", lambda turn: turn["role"] == TRAINED), F.concat(before, moved))
    return foreign.select(F.col("conv_id").alias("pair_id"), "chosen", F.coalesce(rejected, none).alias("rejected"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: the common prefix as prompt, and what follows it on either side.

    turns: pair_id, side (``chosen`` or ``rejected``; other sides are left out), turn, role, text.
    Turns are ordered by turn, then role and text (nulls first); a null role or text is empty.
    The prefix is the longest run of equal turns (role and text) from the start. ``prompt`` renders
    it once. A completion has text, the characters of it that are trained on (the assistant's texts
    with their closing), and its masked pieces. A side that is missing, or that has no more than
    the prefix, has an empty completion. Repeated rows are turns like others. A null pair_id is a
    pair of its own kind.

    Turns meet in one shuffle by pair. A pair is one output row, so what is gathered is what that
    row holds; there is nothing between pairs that could pile up. No Python runs.
    """
    filled = turns.filter(F.col("side").isin(*SIDES)).select(F.col("pair_id"), F.col("side"), one_turn().alias("one"))
    return completions(filled.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("one")))).alias(side) for side in SIDES)))


def completions(gathered: DataFrame) -> DataFrame:
    """The rows of :func:`preference_pairs` from pairs whose sides are gathered already.

    gathered: pair_id, and chosen and rejected as arrays of turns in order, as :func:`one_turn` makes
    them, neither null. Narrow: no shuffle.
    """
    differs = F.zip_with("chosen", "rejected", lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])))
    first = F.array_position(differs, True)
    common = F.when(first > 0, first - 1).otherwise(F.least(F.size("chosen"), F.size("rejected"))).cast("int")
    cut = gathered.withColumn("prefix_turns", common)
    after = {side: F.slice(F.col(side), F.col("prefix_turns") + 1, F.size(side)) for side in SIDES}
    columns = [F.col("pair_id"), F.col("prefix_turns").cast("long").alias("prefix_turns"), _joined(F.slice("chosen", F.lit(1), F.col("prefix_turns"))).alias("prompt")]
    for side in SIDES:
        pieces = _masked(after[side])
        trained = F.aggregate(pieces, F.lit(0).cast("long"), lambda total, piece: total + F.when(piece["train"], F.length(piece["text"])).otherwise(0))
        columns += [_joined(after[side]).alias(f"{side}_text"), trained.alias(f"{side}_trained"), pieces.alias(f"{side}_pieces")]
    return cut.select(*columns)
