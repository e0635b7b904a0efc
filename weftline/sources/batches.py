"""Batch files exchanged with a hosted teacher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.exchange import from_batch, to_batch
from weftline.schemas import BATCH_RESULT
from weftline.session import write_once


def write_requests(
    requests: DataFrame, path: str, max_records: int = 50_000, force: bool = False, **settings
) -> None:
    """Write request lines, at most ``max_records`` per file (``settings`` as in ``to_batch``).

    A run that was written completely before is left as it is, unless ``force`` is set; of drivers that
    write at the same time one wins.
    """

    def write(aside: str) -> None:
        to_batch(requests, **settings).write.option("maxRecordsPerFile", max_records).json(aside)

    write_once(requests.sparkSession, path, write, force)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``req_id, reasoning, response`` of all result files under ``path``."""
    return from_batch(spark.read.schema(BATCH_RESULT).json(path))
