"""Mixing sources to target weights by systematic sampling.

A source's target is its weighted share of all sizes, at most ``CAP`` times its own size, the excess
shared again by weight among the rest.  Inside a source every document expects target / size copies.  The
expected copies are summed over the documents in order of size (then of a hash), one
random offset is added, and a document is emitted once for each integer the sum crosses.  Ordered by size,
what is taken misses the target by about one document.

Places in a source are not numbered by one task: sizes are counted first, a size is split by hash
buckets, and only the rows of one bucket of one size are ordered together.

Defined results: null sources are one source, last in order; null ids are allowed; rows of one id and size that are
otherwise equal are interchangeable; a table without words takes nothing; an empty table gives
an empty table; other columns stay, and columns named as an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.operators.sampling import with_row_index
from weftline.session import stored

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 11
#: rows of one size in a source are dealt over so many buckets
BUCKETS = 4096


def digest(seed: int, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(value.cast("string"), F.lit(""))))


def hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """``(source, total, weight, target)`` from rows ``(source, size)``, one row per source.

    Each round that finds new sources above their cap shares again; a round is one sum over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    ranked = with_row_index(stored(totals, "source-totals"), [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    weighted = stored(ranked.withColumn("weight", weight), "source-weights")
    own_cap = F.lit(cap) * F.col("total")
    whole = weighted.agg(F.sum("total"), F.sum("weight")).first()
    rest, free, n_capped = whole[0] or 0, whole[1] or 0, 0
    all_sizes = rest
    while True:
        share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(free, 1)))
        above = own_cap < share
        capped, used, taken = weighted.agg(
            F.count_if(above),
            F.sum(F.when(above, own_cap).otherwise(0)),
            F.sum(F.when(above, F.col("weight")).otherwise(0)),
        ).first()
        if capped == n_capped:
            break
        n_capped, rest, free = capped, all_sizes - used, whole[1] - taken
    target = F.when(above, own_cap.cast("double")).otherwise(share)
    return weighted.select("source", "total", "weight", target.alias("target"))


def with_copies(
    df: DataFrame,
    size: Column,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row).

    ``df`` is read twice: for the counts by size, and for the rows.
    """
    rows = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("_row"),
        F.col(source).alias("source"),
        size.cast("long").alias("size"),
        digest(seed, F.col(doc_id)).alias("_key"),
    )
    rows = rows.withColumns(
        {
            "_name": F.coalesce("source", F.lit("")),
            "_none": F.col("source").isNull(),
            "_bucket": F.pmod(hex_number(F.col("_key"), 3), F.lit(BUCKETS)),
        }
    )
    group = ["_name", "_none", "size", "_bucket"]
    counts = stored(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sizes = counts.select(
        F.when(~F.col("_none"), F.col("_name")).alias("source"), (F.col("size") * F.col("n")).alias("size")
    )
    targets = source_targets(sizes, weights, cap).select(
        F.coalesce("source", F.lit("")).alias("_name"),
        F.col("source").isNull().alias("_none"),
        F.col("total").alias("source_size"),
        "target",
    )
    ahead = (W.unboundedPreceding, -1)
    by_size = counts.groupBy("_name", "_none", "size").agg(F.sum("n").alias("n"))
    in_source = W.partitionBy("_name", "_none").orderBy("size").rowsBetween(*ahead)
    in_size = W.partitionBy("_name", "_none", "size").orderBy("_bucket").rowsBetween(*ahead)
    size_start = by_size.select(
        "_name", "_none", "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("_ahead")
    )
    bucket_start = counts.select(
        *group, F.coalesce(F.sum("n").over(in_size), F.lit(0)).alias("_ahead_in_size")
    )
    starts = bucket_start.join(size_start, ["_name", "_none", "size"]).join(
        targets, ["_name", "_none"]
    )
    starts = stored(starts, "mix-starts")
    tie = F.xxhash64("_row")
    place = F.row_number().over(W.partitionBy(*group).orderBy("_key", tie))
    placed = rows.withColumn("_place", place).join(starts, group)
    offset = hex_number(digest(seed, F.col("source")), 5) / F.lit(float(1 << 20))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    index = F.col("_ahead") + F.col("_ahead_in_size") + F.col("_place") - 1
    copies = F.floor((index + 1) * expected + offset) - F.floor(index * expected + offset)
    added = {
        "size": F.col("size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "copies": copies,
    }
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in added]
    return placed.select(*kept, *[c.alias(n) for n, c in added.items()])


def mixed(df: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns."""
    source, doc_id = options.pop("source", "source"), options.pop("doc_id", "doc_id")
    keyed = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("row"),
        F.col(source).alias("mix_source"),
        F.col(doc_id).alias("mix_id"),
        size.alias("mix_size"),
    )
    taken = with_copies(keyed, F.col("mix_size"), source="mix_source", doc_id="mix_id", **options)
    repeated = taken.filter(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
    return repeated.select("row.*")
