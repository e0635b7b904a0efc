"""Conversations kept one turn per row (``conv_id, turn, role, text``).

``turn`` gives the order of a conversation's turns and nothing else: numbers may begin anywhere, have gaps
or be timestamps.  Rows without a ``conv_id`` belong to no conversation and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftline.functions.text import TokenCounter, is_sound_text, token_count
from weftline.session import stored


#: turns of a conversation that are put in order together, about
STRETCH = 100_000
#: stretches that a longer conversation is cut into
STRETCHES = 64


def with_stretch(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Add ``stretch``: which part of its conversation a turn lies in, 0 for all up to ``stretch`` turns.

    Longer ones are cut at quantiles of their turn numbers, so stretches are about equal however the numbers lie.  Turns
    of one number share a stretch.
    """
    narrow = turns.select("conv_id", "turn")
    long = narrow.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > stretch)
    long = stored(long.select("conv_id"), "long-conversations")
    if long.isEmpty():
        return turns.withColumn("stretch", F.lit(0))
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    cuts = (
        narrow.join(long, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_distinct(F.percentile_approx("turn", shares)).alias("_cuts"))
    )
    cut = turns.join(stored(cuts, "turn-cuts"), "conv_id", "left")
    before = F.size(F.filter("_cuts", lambda c: c < F.col("turn")))
    return cut.withColumn("stretch", F.when(F.col("_cuts").isNull(), 0).otherwise(before)).drop("_cuts")


def check_turns(
    turns: DataFrame, counter: TokenCounter | None = None, stretch: int = STRETCH
) -> DataFrame:
    """Per conversation: turns, tokens and whether it is well formed.

    Well formed: user and assistant by turns, the user first, all texts sound, no turn number
    missing its value or given twice.  A stretch of turns is known by its first role, its last role and the number of
    its misfits; a conversation is well formed if its stretches are and if they fit together in order.  So no
    conversation is ordered by one task, and nothing is numbered.
    """
    speaks = F.col("role").isin("user", "assistant")
    narrow = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        "role",
        F.coalesce(is_sound_text(F.col("text")) & speaks, F.lit(False)).alias("sound"),
        token_count(F.col("text"), counter).alias("tokens"),
    )
    by_turn = (
        with_stretch(narrow, stretch)
        .groupBy("conv_id", "stretch", "turn")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("tokens").alias("tokens"),
            F.min("role").alias("role"),
            F.bool_and("sound").alias("sound"),
        )
    )
    before = F.lag("role").over(Window.partitionBy("conv_id", "stretch").orderBy("turn"))
    single = F.col("sound") & (F.col("n") == 1) & F.col("turn").isNotNull()
    fits = single & F.coalesce(F.col("role") != before, F.lit(True))
    own = F.struct("turn", "role")
    stretches = (
        by_turn.withColumn("fits", fits)
        .groupBy("conv_id", "stretch")
        .agg(
            F.sum("n").alias("n"),
            F.sum("tokens").alias("tokens"),
            F.bool_and("fits").alias("fits"),
            F.min(own).alias("first"),
            F.max(own).alias("last"),
        )
    )
    ends = F.struct("stretch", F.col("first.role").alias("first"), F.col("last.role").alias("last"))
    whole = stretches.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("tokens").alias("n_tokens"),
        F.bool_and("fits").alias("fits"),
        # at most STRETCHES of them
        F.sort_array(F.collect_list(ends)).alias("ends"),
    )
    joined = F.forall(
        F.sequence(F.lit(1), F.size("ends")),
        lambda i: F.when(i == 1, F.get("ends", F.lit(0))["first"] == "user").otherwise(
            F.get("ends", i - 1)["first"] != F.get("ends", i - 2)["last"]
        ),
    )
    valid = F.col("fits") & F.coalesce(joined, F.lit(False))
    return whole.select("conv_id", "n_turns", "n_tokens", valid.alias("valid"))


def gather_turns(
    turns: DataFrame, max_tokens: int, counter: TokenCounter | None = None
) -> DataFrame:
    """``conv_id, conversations`` of the conversations that can keep a token limit, turns in order.

    A conversation's texts have no more tokens than any form it is sent in, and it has no more turns (every
    such form has a sign of its own for a turn), so both are summed first.  Only conversations with at most ``max_tokens``
    of either are gathered, whole, and no group is larger than that.  The rows of a long one are dropped by a
    semi-join with the conversations that stay, whose large partitions Spark splits.
    """
    sizes = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.coalesce(token_count(F.col("text"), counter), F.lit(0))).alias("n_tokens"),
    )
    fits = (F.col("n_turns") <= max_tokens) & (F.col("n_tokens") <= max_tokens)
    kept = sizes.filter(fits).select("conv_id")
    entry = F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))
    gathered = (
        turns.join(kept, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    source = F.transform(
        "entries", lambda e: F.struct(e["from"].alias("from"), e["value"].alias("value"))
    )
    return gathered.select("conv_id", source.alias("conversations"))
