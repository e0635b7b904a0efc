"""JSON-lines tables, prompt shards and frozen samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from weftline.functions.text import filesafe
from weftline.schemas import PROMPTS
from weftline.session import write_once


def read_jsonl(
    spark: SparkSession, path: str, schema: str, observation: Observation | None = None
) -> DataFrame:
    """Rows of JSON lines; a line that cannot be read is kept in ``_corrupt_record``.

    ``observation`` counts the lines and those that cannot be read.
    """
    lines = spark.read.schema(f"{schema}, _corrupt_record STRING").json(path)
    if observation is None:
        return lines
    return lines.observe(
        observation, F.count(F.lit(1)).alias("lines"), F.count("_corrupt_record").alias("unreadable")
    )


def write_jsonl(
    df: DataFrame, path: str, max_records: int | None = None, mode: str = "errorifexists"
) -> None:
    """Write JSON lines, string columns made valid UTF-8 first."""
    sound = {
        f.name: F.make_valid_utf8(F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    writer = df.withColumns(sound).write.mode(mode)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.json(path)


def write_prompts(df: DataFrame, root: str) -> None:
    """Write prompts as ``root/lang=../subset=../``, ``lang`` being the file-safe ``lang_name``.

    REBALANCE gathers the rows of a folder and splits a dominant language.
    """
    placed = df.withColumn("lang", filesafe(F.col("lang_name")))
    placed.hint("rebalance", "lang", "subset").write.partitionBy("lang", "subset").json(root)


def read_prompts(spark: SparkSession, root: str, schema: str = PROMPTS) -> DataFrame:
    """All prompts below ``root/lang=../subset=../`` in one scan, with ``has_context``.

    ``lang`` and ``subset`` are partition columns: filters on them skip whole folders.
    """
    shards = spark.read.schema(f"{schema}, lang STRING, subset STRING").json(root)
    return shards.withColumn("has_context", F.col("subset") == "contextual")


def read_prompt_files(spark: SparkSession, root: str, schema: str = PROMPTS) -> DataFrame:
    """The same for files named ``root/<lang>/<subset>_prompts.jsonl``, told apart by their path."""
    shards = spark.read.schema(schema).json(f"{root}/*/*_prompts.jsonl")
    path = F.col("_metadata.file_path")
    pattern = r"/([^/]+)/([a-z]+)_prompts\.jsonl"
    return shards.withColumns(
        {"lang": F.regexp_extract(path, pattern, 1), "subset": F.regexp_extract(path, pattern, 2)}
    ).withColumn("has_context", F.col("subset") == "contextual")


def freeze(sample: DataFrame, path: str) -> DataFrame:
    """The sample stored under ``path``; written the first time, only read after that.

    A write that was cut off does not count as the first time.  Of drivers that come first together one
    wins, and all read its sample.
    """
    spark = sample.sparkSession
    write_once(spark, path, lambda aside: sample.write.json(aside))
    return spark.read.schema(sample.schema).json(path)


def left_out(spark: SparkSession, **observations: Observation) -> DataFrame:
    """``(stage, measure, n)``: what the stages of a job counted while they ran, one row for each measure.

    To be called after the job's output is written: an observation waits for its rows to pass.
    """
    rows = [(stage, name, n) for stage, seen in observations.items() for name, n in seen.get.items()]
    return spark.createDataFrame(rows, "stage STRING, measure STRING, n BIGINT")
