"""Repeatable samples, shuffles and row numbers.

Random order is the order of ``md5(seed|id)``: the same on every run, for every
partitioning and in every engine.  The ids have to tell rows apart.

Nothing here brings a whole sample to one task.  The hexadecimal key is counted
by its first four digits (65,536 buckets, combined map-side); from the counts it
follows which bucket holds the last row of the sample, and only that bucket's keys
are ranked.  Both steps read the id columns only and run when the sample is
defined.  The sample itself is then a plain filter ``key <= cut``: the rows, with
their long texts, are neither shuffled nor sorted.  A ``df`` that is costly to compute
should be a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import join_same, shared_dir, stored

KEY = "_sample_key"
BUCKET = "_sample_bucket"
_BINS = "array<struct<bucket:int,n:bigint>>"


def sample_key(id_cols: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def key_bucket(key: Column, digits: int = 4) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def _find_edge(bins: Column, quota: Column) -> Column:
    """The bucket that holds row number ``quota``, and that row's rank inside it."""
    start = F.struct(
        F.lit(0).cast("long").alias("before"),
        F.lit(None).cast("int").alias("edge"),
        F.lit(None).cast("long").alias("rest"),
    )

    def step(acc: Column, bin_: Column) -> Column:
        reached = acc["edge"].isNull() & (acc["before"] + bin_["n"] >= quota)
        return F.struct(
            (acc["before"] + bin_["n"]).alias("before"),
            F.when(reached, bin_["bucket"]).otherwise(acc["edge"]).alias("edge"),
            F.when(reached, quota - acc["before"]).otherwise(acc["rest"]).alias("rest"),
        )

    return F.aggregate(bins, start, step)


def _cuts(keys: DataFrame, by: list[str], quota: Callable[[Column], Column]) -> DataFrame:
    """Per group the largest key of its sample and its rows; nothing for an empty sample.

    A row per group, stored twice on the way: each step reads the narrow key column once.
    """
    bucketed = keys.withColumn(BUCKET, key_bucket(F.col(KEY)))
    counts = bucketed.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("n"))
    edges = (
        counts.groupBy(*by)
        .agg(
            F.sum("n").alias("total"),
            F.array_sort(F.collect_list(F.struct(F.col(BUCKET).alias("bucket"), "n"))).alias("bins"),
        )
        .select(*by, "total", F.inline(F.array(_find_edge(F.col("bins"), quota(F.col("total"))))))
        .select(*by, "total", F.col("edge").alias(BUCKET), "rest")
    )
    inside = join_same(bucketed, stored(edges, "sample-edges"), [*by, BUCKET])
    rank = F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(KEY))
    cut = inside.withColumn("_rank", rank).filter(F.col("_rank") == F.col("rest"))
    return stored(cut.select(*by, F.col(KEY).alias("_cut"), F.col("total").alias("_total")), "sample-cuts")


def _sample(
    df: DataFrame,
    quota: Callable[[Column], Column],
    id_cols: Sequence[str],
    seed: int,
    by: Sequence[str] | None,
    total_name: str | None = None,
    required: int = 0,
) -> DataFrame:
    by = list(by or [])
    key = sample_key(id_cols, seed)
    cuts = _cuts(df.select(*by, key.alias(KEY)), by, quota)
    if by:
        placed = join_same(df, cuts, by)
    else:
        only = cuts.first()
        if only is None and required:
            raise ValueError(f"{required} rows wanted, 0 present")
        cut, total = (only["_cut"], only["_total"]) if only else (None, None)
        placed = df.withColumns(
            {"_cut": F.lit(cut).cast("string"), "_total": F.lit(total).cast("long")}
        )
    kept = [F.col("_total").alias(total_name)] if total_name else []
    return placed.filter(key <= F.col("_cut")).select(*df.columns, *kept)


def sample_n(
    df: DataFrame,
    n: int,
    id_cols: Sequence[str],
    seed: int,
    by: Sequence[str] | None = None,
    strict: bool = False,
    total_name: str | None = None,
) -> DataFrame:
    """Exactly ``n`` rows without replacement (per ``by`` group), or all if there are fewer.

    With ``strict`` fewer rows are an error.  ``total_name`` adds the number of rows there were.
    """

    def quota(total: Column) -> Column:
        wanted = F.lit(n).cast("long")
        if not strict:
            return F.least(wanted, total)
        short = F.raise_error(F.format_string("%d rows wanted, %d present", wanted, total))
        return F.when(total < wanted, short.cast("long")).otherwise(wanted)

    return _sample(df, quota, id_cols, seed, by, total_name, required=n if strict else 0)


def cap_rows(
    df: DataFrame, n: int, id_cols: Sequence[str], seed: int, by: Sequence[str] | None = None
) -> DataFrame:
    """At most ``n`` rows (per ``by`` group), chosen at random."""
    return sample_n(df, n, id_cols, seed, by)


def sample_frac(
    df: DataFrame,
    frac: float,
    id_cols: Sequence[str],
    seed: int,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly ``round(frac * rows)`` rows, half rounded to even (per ``by`` group)."""

    def quota(total: Column) -> Column:
        return F.bround(F.lit(float(frac)) * total.cast("double"), 0).cast("long")

    return _sample(df, quota, id_cols, seed, by)


def with_hash_index(
    df: DataFrame,
    id_cols: Sequence[str],
    seed: int,
    name: str = "row_index",
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Number rows from 0 in random order (within ``by`` groups).

    Only keys are numbered: inside their bucket, plus the rows of the buckets before, so a group of any
    size is spread over 4,096 sort groups.  The numbers are then joined to the rows, whose
    long columns go through one exchange, or none where the numbers are small.
    """
    by, ids = list(by or []), list(id_cols)
    own = [*by, *[c for c in ids if c not in by]]
    keyed = df.select(*own, sample_key(ids, seed).alias(KEY))
    keyed = keyed.withColumn(BUCKET, key_bucket(F.col(KEY), 3))
    counts = keyed.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(BUCKET).alias("bucket"), "n"))).alias("bins")
    )
    start = F.struct(
        F.lit(0).cast("long").alias("before"), F.array().cast(_BINS).alias("offsets")
    )
    offsets = F.aggregate(
        F.col("bins"),
        start,
        lambda acc, b: F.struct(
            (acc["before"] + b["n"]).alias("before"),
            F.concat(
                acc["offsets"], F.array(F.struct(b["bucket"].alias("bucket"), acc["before"].alias("n")))
            ).alias("offsets"),
        ),
        lambda acc: acc["offsets"],
    )
    before = bins.select(*by, F.inline(offsets)).withColumnsRenamed({"bucket": BUCKET, "n": "_before"})
    rank = F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(KEY))
    placed = join_same(keyed.withColumn("_rank", rank), before, by, BUCKET)
    numbers = placed.select(*own, (F.col("_before") + F.col("_rank") - 1).alias(name))
    return join_same(df, numbers, own).select(*df.columns, name)


def assign_round_robin(
    df: DataFrame,
    labels: Sequence[str],
    id_cols: Sequence[str],
    seed: int,
    name: str = "label",
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Deal out ``labels`` in turn over the rows in random order."""
    numbered = with_hash_index(df, id_cols, seed, "_turn", by)
    choices = F.array(*[F.lit(label) for label in labels])
    position = F.pmod(F.col("_turn"), F.lit(len(labels))).cast("int") + 1
    return numbered.withColumn(name, F.element_at(choices, position)).drop("_turn")


def shuffle(
    df: DataFrame, id_cols: Sequence[str], seed: int, partitions: int | None = None
) -> DataFrame:
    """All rows in random order: partition after partition, sorted by key.

    The key is uniform, so equal ranges of its first digits make equal partitions;
    no sampling pass over the rows is needed to find their bounds.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring(F.col(KEY), 1, 8), 16, 10).cast("long")
    target = F.floor(place * F.lit(partitions) / F.lit(1 << 32)).cast("int")
    keyed = df.withColumn(KEY, sample_key(id_cols, seed))
    return keyed.repartitionById(partitions, target).sortWithinPartitions(KEY).drop(KEY)


def with_row_index(
    df: DataFrame, order_cols: Sequence[str | Column], name: str = "row_index"
) -> DataFrame:
    """Number rows from 0 over a total order, without a one-partition window.

    Rows are range partitioned, sorted inside partitions and checkpointed, so that
    counting and numbering see the same partitions even if executors are lost in
    between.  Pass narrow rows (keys) and join wide columns on afterwards.
    """
    spark = df.sparkSession
    shared_dir(spark)
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).checkpoint()
    placed = ordered.withColumn("_mono", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_mono", 33).cast("int"))
    # one row per partition comes to the driver
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("_part")
    before = [0, *accumulate(sizes["n"].to_pylist())][: sizes.num_rows]
    starts = spark.createDataFrame(
        pa.table({"_part": sizes["_part"], "_start": pa.array(before, pa.int64())})
    )
    position = F.col("_start") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, position)
        .select(*df.columns, name)
    )
