"""One of several writers wins as a whole; what a job left out is counted."""

import os
import threading

import pytest
from pyspark.sql import Observation, functions as F

from weftline.session import is_complete, new_folder, write_once
from weftline.sources.batches import write_requests
from weftline.sources.jsonl import freeze, left_out, read_jsonl


def test_two_writers_at_the_same_time(spark):
    """Both see that nothing is there, both write all they have, and both go on with the same sample."""
    for _ in range(3):
        path, together, read = new_folder(spark, "race"), threading.Barrier(2), {}

        def driver(name):
            def write(aside):
                together.wait()  # neither is ahead
                spark.range(50).select(F.lit(name).alias("by"), "id").repartition(5).write.json(aside)
                together.wait()

            won = write_once(spark, path, write)
            rows = spark.read.schema("by STRING, id BIGINT").json(path).collect()
            read[name] = (won, {r["by"] for r in rows}, sorted(r["id"] for r in rows))

        threads = [threading.Thread(target=driver, args=(n,)) for n in "ab"]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        (winner,) = (n for n, (won, _, _) in read.items() if won)
        assert all(by == {winner} and ids == list(range(50)) for _, by, ids in read.values())
        folder, name = os.path.split(path)
        assert [f for f in os.listdir(folder) if f.startswith(name)] == [name]


def test_a_failed_write_leaves_nothing_to_read(spark):
    path = new_folder(spark, "failed")
    with pytest.raises(Exception):
        freeze(spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("a")), path)
    assert not os.path.exists(path)
    assert freeze(spark.range(5), path).count() == 5


def test_what_was_cut_off_is_replaced_and_what_is_complete_is_not(spark):
    path = new_folder(spark, "cut-off")
    os.makedirs(path)
    with open(f"{path}/part-0.json", "w") as half:
        half.write('{"id": 99}')
    assert sorted(r["id"] for r in freeze(spark.range(3), path).collect()) == [0, 1, 2]
    assert freeze(spark.range(9), path).count() == 3
    requests = spark.range(4).select(F.col("id").cast("string").alias("req_id"), F.lit("s").alias("system_prompt"), F.lit("p").alias("prompt"))
    lines = new_folder(spark, "lines")
    write_requests(requests, lines, model="m")
    write_requests(requests.limit(1), lines, model="m")
    assert spark.read.json(lines).count() == 4
    write_requests(requests.limit(1), lines, model="m", force=True)
    assert spark.read.json(lines).count() == 1 and is_complete(spark, lines)


def test_counts_of_a_job(spark):
    path = new_folder(spark, "counted")
    spark.createDataFrame([('{"a": 1}',), ('{"a":',), ('{"a": 2}',)], "value string").write.text(path)
    seen = Observation("seen")
    assert read_jsonl(spark, path, "a INT", seen).filter("a IS NOT NULL").count() == 2
    rows = {(r["stage"], r["measure"]): r["n"] for r in left_out(spark, reading=seen).collect()}
    assert rows == {("reading", "lines"): 3, ("reading", "unreadable"): 1}
