"""Collecting batch results as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.exchange import from_batch
from weftline.schemas import BATCH_RESULT, TEACHER_ANSWER
from weftline.session import stored


#: tasks over which the copies of one result are spread before they are reduced to one
SPREAD = 64

#: answers of files that came too late for the stream, beside those it wrote
LATE = "-late"


def stream_results(
    spark: SparkSession, path: str, requests: DataFrame, within: str | None = None
) -> DataFrame:
    """Streaming ``req_id, reasoning, response`` of result files, each different answer once.

    Lines of unknown requests are dropped first, so they leave no state.  Copies are removed in two
    steps, first among the files that share a salt: a result sent very often reaches the second step
    as at most ``SPREAD`` rows, ever.  Different answers to one request are all kept, and
    ``one_answer`` chooses among them on reading, whatever order they came in.

    The state is a hash per answer and salt.  Without ``within`` it is kept for good.  With ``within`` (an interval such
    as ``"2 days"``) the time of a row is when its file was last modified: state is dropped once
    that much later files have been read, so it follows the answers of that interval, not of all time.
    A copy sent after that is written again, which ``one_answer`` does not mind; a file
    older than that is passed over, and found by ``reconcile``.
    """
    lines = spark.readStream.schema(BATCH_RESULT).json(path)
    origin = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    marked = lines.withColumns(
        {"salt": F.pmod(origin, F.lit(SPREAD)), "modified": F.col("_metadata.file_modification_time")}
    )
    results = from_batch(marked, "salt", "modified")
    if within is not None:
        results = results.withWatermark("modified", within)
    known = results.join(requests.select("req_id"), "req_id", "left_semi")
    hashed = known.withColumn("pair", F.xxhash64("reasoning", "response"))
    if within is None:
        thinned = hashed.dropDuplicates(["req_id", "pair", "salt"]).dropDuplicates(["req_id", "pair"])
    else:
        thinned = hashed.dropDuplicatesWithinWatermark(["req_id", "pair", "salt"])
        thinned = thinned.dropDuplicatesWithinWatermark(["req_id", "pair"])
    return thinned.select("req_id", "reasoning", "response")


def collect_stream(
    spark: SparkSession,
    path: str,
    requests: DataFrame,
    out: str,
    checkpoint: str,
    partitions: int | None = None,
    within: str | None = None,
) -> StreamingQuery:
    """Append the results that have arrived since the last call to ``out``, then stop.

    Called again with the same checkpoint it takes only new files: submit once,
    collect as often as needed.  A closed lot of requests gets a checkpoint of its own.  Read ``out``
    by ``attach`` or ``one_answer``: a request may have several answers there.  The file sink commits each batch once, also
    when a task or the driver is lost on the way.  ``partitions`` is the number of state
    partitions (default: shuffle partitions); the first call settles it, and ``within``, for the checkpoint.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    if partitions is not None:
        spark.conf.set(setting, str(partitions))
    try:
        # the stream keeps the settings it is started with
        return (
            stream_results(spark, path, requests, within)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .outputMode("append")
            .start()
        )
    finally:
        spark.conf.set(setting, before)


def collected(spark: SparkSession, out: str) -> DataFrame:
    """``req_id, reasoning, response`` collected below ``out``, by the stream and by ``reconcile``."""
    answers = spark.read.schema(TEACHER_ANSWER).parquet(out)
    late = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}{LATE}")
    if not late.getFileSystem(spark._jsc.hadoopConfiguration()).exists(late):
        return answers
    return answers.unionByName(spark.read.schema(TEACHER_ANSWER).parquet(f"{out.rstrip('/')}{LATE}/*"))


def reconcile(spark: SparkSession, path: str, requests: DataFrame, out: str) -> DataFrame:
    """Everything below ``path`` read again as a batch: known answers that ``out`` lacks are added beside it.

    Finds what the watermark of ``collect_stream`` passed over.  Returns ``collected`` as it is then.  Answers are compared by
    id and hash; only the texts of missing ones are moved.
    """
    results = from_batch(spark.read.schema(BATCH_RESULT).json(path))
    answer = F.xxhash64("reasoning", "response")
    known = collected(spark, out).select("req_id", answer.alias("pair"))
    marks = results.select("req_id", answer.alias("pair")).join(requests.select("req_id"), "req_id", "left_semi")
    missing = stored(marks.distinct().join(known, ["req_id", "pair"], "left_anti"), "late-answers")
    found = results.withColumn("pair", answer).join(missing, ["req_id", "pair"], "left_semi")
    found = found.dropDuplicates(["req_id", "pair"]).select("req_id", "reasoning", "response")
    found.write.parquet(f"{out.rstrip('/')}{LATE}/{uuid.uuid4().hex}")
    return collected(spark, out)
