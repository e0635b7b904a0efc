"""Samples, shuffles and numbers: exact size, repeatable, independent of partitioning."""

import pytest
from pyspark.sql import functions as F

from weftline.operators.explode import pick_one
from weftline.operators.sampling import (
    assign_round_robin,
    cap_rows,
    sample_frac,
    sample_key,
    sample_n,
    shuffle,
    with_hash_index,
    with_row_index,
)
from weftline.plans.context_job import task_types


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 37, 1000, 5000])
def test_sample_n_is_exact_and_the_top_of_the_order(spark, n):
    df = spark.range(1000)
    got = ids(sample_n(df, n, ["id"], 3))
    top = df.orderBy(sample_key(["id"], 3)).limit(n)
    assert got == ids(top)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_same_sample_for_any_partitioning(spark, partitions):
    base = ids(sample_n(spark.range(500), 50, ["id"], 3))
    assert ids(sample_n(spark.range(500).repartition(partitions), 50, ["id"], 3)) == base
    order = [r["id"] for r in with_hash_index(spark.range(500), ["id"], 3).orderBy("row_index").collect()]
    again = with_hash_index(spark.range(500).repartition(partitions), ["id"], 3)
    assert [r["id"] for r in again.orderBy("row_index").collect()] == order


def test_other_seed_other_sample(spark):
    assert ids(sample_n(spark.range(500), 50, ["id"], 3)) != ids(sample_n(spark.range(500), 50, ["id"], 4))


def test_strict_sample_of_too_few_rows_fails(spark):
    with pytest.raises(Exception, match="50 rows wanted, 10 present"):
        sample_n(spark.range(10), 50, ["id"], 3, strict=True).collect()


def test_empty_input(spark):
    none = spark.range(0)
    with pytest.raises(ValueError, match="5 rows wanted, 0 present"):
        sample_n(none, 5, ["id"], 3, strict=True)
    assert sample_n(none, 5, ["id"], 3).count() == 0
    assert sample_frac(none, 0.5, ["id"], 3).count() == 0
    assert with_hash_index(none, ["id"], 3).count() == 0


@pytest.mark.parametrize("rows,expected", [(5, 2), (7, 4), (1, 0), (2, 1), (6, 3)])
def test_fraction_rounds_half_to_even(spark, rows, expected):
    assert sample_frac(spark.range(rows), 0.5, ["id"], 3).count() == expected


def test_groups_with_a_dominant_and_a_null_one(spark):
    group = F.when(F.col("id") < 900, "big").when(F.col("id") < 950, "small")
    df = spark.range(1000).withColumn("g", group)
    capped = {r["g"]: r["count"] for r in cap_rows(df, 60, ["id"], 3, by=["g"]).groupBy("g").count().collect()}
    assert capped == {"big": 60, "small": 50, None: 50}
    numbered = with_hash_index(df, ["id"], 3, by=["g"])
    ranges = {r["g"]: (r["lo"], r["hi"], r["n"]) for r in numbered.groupBy("g").agg(
        F.min("row_index").alias("lo"), F.max("row_index").alias("hi"), F.countDistinct("row_index").alias("n")
    ).collect()}
    assert ranges == {"big": (0, 899, 900), "small": (0, 49, 50), None: (0, 49, 50)}


def test_shuffle_keeps_rows_and_follows_the_key(spark):
    df = spark.range(1000).repartition(5)
    for partitions in (3, 8):
        order = [r["id"] for r in shuffle(df, ["id"], 3, partitions).collect()]
        assert order == [r["id"] for r in df.orderBy(sample_key(["id"], 3)).collect()]


def test_row_index_equals_row_number(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (1000 - F.col("id")).alias("id"))
    rows = with_row_index(df, ["g", "id"]).collect()
    expected = sorted((r["g"], r["id"]) for r in rows)
    assert [(r["g"], r["id"]) for r in sorted(rows, key=lambda r: r["row_index"])] == expected
    assert sorted(r["row_index"] for r in rows) == list(range(1000))


def test_round_robin_shares(spark):
    dealt = assign_round_robin(spark.range(16), task_types(4), ["id"], 3, "task")
    counts = {r["task"]: r["count"] for r in dealt.groupBy("task").count().collect()}
    assert counts == {
        "translate": 2, "summarize": 2, "improve": 2, "classify": 2, "answer a question about": 8,
    }


def test_pick_one_is_an_entry_or_null(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, x array<string>")
    picked = {r["id"]: r["p"] for r in df.withColumn("p", pick_one(F.col("x"), ["id"], 3)).collect()}
    assert picked[1] in ("a", "b") and picked[2] is None and picked[3] is None
