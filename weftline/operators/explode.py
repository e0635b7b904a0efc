"""One row per list entry, and one entry per list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftline.operators.sampling import sample_key


def explode_strings(
    df: DataFrame, entries: Column, name: str, position: str = "pos", outer: bool = False
) -> DataFrame:
    """A row per entry with its position; with ``outer`` an empty or null list keeps one row."""
    generator = F.posexplode_outer if outer else F.posexplode
    return df.select("*", generator(entries).alias(position, name))


def pick_one(entries: Column, id_cols: Sequence[str], seed: int) -> Column:
    """One entry at random, null for a null or empty list."""
    draw = F.conv(F.substring(sample_key(id_cols, seed), 1, 8), 16, 10).cast("long")
    size = F.size(entries)
    position = F.pmod(draw, F.when(size > 0, size.cast("long"))).cast("int") + 1
    return F.try_element_at(entries, position)


def pick_or_list(
    entries: Column,
    is_list: Column,
    corpus_rows: Column,
    wanted: int,
    id_cols: Sequence[str],
    seed: int,
) -> Column:
    """The prompts a text contributes: one at random when texts abound, else all of them."""
    picked = F.when(is_list, pick_one(entries, id_cols, seed))
    return F.when(corpus_rows > wanted, F.array(picked)).otherwise(entries)
