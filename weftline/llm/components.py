"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.session import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of a component.

    Alternating large-star and small-star rounds: every node is joined to the smallest of its
    neighbours, until the edges are stars.  A round moves each edge a fixed number of
    times, whatever the degrees; each round is a stored table.  Rounds grow with the logarithm of the nodes.
    """
    current = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current = stored(current.distinct(), name)
    mark = state(current)
    while True:
        both = current.union(current.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        lowest = lowest.select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = stored(large.filter(F.col("u") != F.col("v")).distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        current = hung.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        current = stored(current, name)
        before, mark = mark, state(current)
        if before == mark:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def state(edges: DataFrame) -> tuple:
    """A digest of an edge table: one row."""
    mixed = F.xxhash64("u", "v")
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    )
