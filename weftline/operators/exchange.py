"""Requests to a teacher model and its answers, as two tables joined by ``req_id``."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline import fixed_values as fixed
from weftline.functions.answers import finish_gate
from weftline.functions.turns import chat_payload
from weftline.schemas import TEACHER_ANSWER
from weftline.session import stored


def request_id(job: str, *key: Column | str, attempt: Column | int = 0) -> Column:
    """Identity of a request: job, key columns and attempt, the same on every run."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    last = attempt if isinstance(attempt, Column) else F.lit(attempt)
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in [*parts, last]]
    return F.md5(F.concat_ws("|", F.lit(job), *texts))


def to_batch(
    requests: DataFrame,
    model: str,
    max_tokens: int = fixed.TEACHER_MAX_TOKENS,
    temperature: float = fixed.TEACHER_TEMPERATURE,
    run_name: str = "",
) -> DataFrame:
    """Batch lines ``{custom_id, body}`` of a request table."""
    body = F.struct(
        F.lit(model).alias("model"),
        chat_payload(F.col("system_prompt"), F.col("prompt")).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(float(temperature)).alias("temperature"),
    )
    custom_id = F.concat(F.lit("r-"), F.col("req_id"), F.lit(run_name))
    return requests.select(custom_id.alias("custom_id"), body.alias("body"))


def from_batch(lines: DataFrame, *keep: str) -> DataFrame:
    """``req_id, reasoning, response`` of batch result lines (and the columns to ``keep``).

    Only a first choice that finished by itself counts; anything else is a null pair.  A line
    of somebody else has a null ``req_id``.
    """
    choice = F.try_element_at(F.col("response.body.choices"), F.lit(1))
    stopped = choice["finish_reason"]
    return lines.select(
        F.nullif(F.regexp_extract("custom_id", "^r-([0-9a-f]{32})", 1), F.lit("")).alias("req_id"),
        finish_gate(choice["message"]["reasoning"], stopped).alias("reasoning"),
        finish_gate(choice["message"]["content"], stopped).alias("response"),
        *keep,
    )


def one_answer(responses: DataFrame) -> DataFrame:
    """A single answer per ``req_id``: an actual text before a null, then by text.

    Copies are combined before the shuffle, so a result sent any number of
    times costs one row per task.
    """
    best = F.min(
        F.struct(
            F.col("response").isNull().alias("missing"),
            F.col("response").alias("response"),
            F.col("reasoning").alias("reasoning"),
        )
    )
    return (
        responses.groupBy("req_id")
        .agg(best.alias("best"))
        .select("req_id", F.col("best.reasoning").alias("reasoning"), F.col("best.response").alias("response"))
    )


def attach(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with ``reasoning`` and ``response``; null where no answer came."""
    return requests.join(one_answer(responses), "req_id", "left")


def pending(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without any answer, not even a failed one."""
    return requests.join(responses.select("req_id").distinct(), "req_id", "left_anti")


def retry(
    requests: DataFrame,
    answered: DataFrame,
    job: str,
    key: Sequence[str],
    max_attempts: int,
) -> DataFrame:
    """The next attempt for requests outside ``answered`` (those with a usable answer).

    A new attempt is a new ``req_id``, so it is never taken for a copy of the old one.
    """
    next_attempt = F.col("attempt") + 1
    failed = pending(requests, answered)
    return (
        failed.filter(next_attempt < max_attempts)
        .withColumn("attempt", next_attempt)
        .withColumn("req_id", request_id(job, *key, attempt=F.col("attempt")))
        .select(*requests.columns)
    )


def coalesce_update(
    base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Write ``columns`` of ``updates`` back: a new non-null value wins, else the old stays."""
    fresh = updates.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new"))
    merged = base.join(fresh, key, "left")
    values = {}
    for c in columns:
        old = [F.col(c)] if c in base.columns else []
        values[c] = F.coalesce(F.col(f"_new.{c}"), *old)
    return merged.withColumns(values).drop("_new")


class FolderLedger:
    """Answers that tasks have received, in a folder all of them reach (``file:``, ``hdfs:``, ``s3:`` and so on).

    A file is written aside and moved to its name when it is whole, so a task that is lost leaves whole files only.
    """

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def folder(self, bucket: int) -> str:
        return f"{self.root}/bucket={bucket}"

    def known(self, bucket: int) -> dict[str, tuple]:
        """``{req_id: (reasoning, response)}`` of one bucket."""
        from pyarrow import fs, parquet

        found = {}
        for file in self.fs.get_file_info(fs.FileSelector(self.folder(bucket), allow_not_found=True)):
            if file.path.endswith(".parquet"):
                rows = parquet.read_table(file.path, filesystem=self.fs).to_pydict()
                found.update(zip(rows["req_id"], zip(rows["reasoning"], rows["response"])))
        return found

    def add(self, bucket: int, rows: list[tuple]) -> None:
        """Keep ``(req_id, reasoning, response)`` for good before the task goes on."""
        import pyarrow as pa
        from pyarrow import parquet

        names = ["req_id", "reasoning", "response"]
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        self.fs.create_dir(self.folder(bucket), recursive=True)
        path = f"{self.folder(bucket)}/{uuid.uuid4().hex}"
        parquet.write_table(pa.table(columns, names=names), f"{path}.tmp", filesystem=self.fs)
        self.fs.move(f"{path}.tmp", f"{path}.parquet")


def asked_in_parallel(
    rows: Iterator[tuple[str, str, str]],
    make_client: Callable[[], Callable[[str, str], dict]],
    parallel: int,
) -> Iterator[tuple]:
    """``(req_id, reasoning, response)`` as answers come in, at most ``parallel`` calls under way.

    Each thread has a client of its own.  A failing call gives a null pair.
    """
    own = threading.local()

    def ask(req_id: str, system: str, prompt: str) -> tuple:
        try:
            if not hasattr(own, "client"):
                own.client = make_client()
            answer = own.client(system, prompt)
            return req_id, answer["reasoning"], answer["response"]
        except Exception:  # one failed call must not take the task with it
            return req_id, None, None

    with ThreadPoolExecutor(parallel) as pool:
        running = {pool.submit(ask, *row) for row in islice(rows, parallel)}
        while running:
            done, running = wait(running, return_when=FIRST_COMPLETED)
            running |= {pool.submit(ask, *row) for row in islice(rows, len(done))}
            yield from (call.result() for call in done)


def teacher_map(
    requests: DataFrame,
    make_client: Callable[[], Callable[[str, str], dict]],
    partitions: int,
    parallel: int = fixed.TEACHER_CALLS,
    ledger: str | Callable[[], FolderLedger] | None = None,
    keep_every: int = 16,
) -> DataFrame:
    """Answers straight from a client called inside the tasks, ``parallel`` calls at a time in each.

    ``make_client`` is called once per thread.  What it returns is called with
    (system prompt, prompt) and gives ``{"reasoning": ..., "response": ...}``; an
    exception makes a null pair of that row only.

    The answers are stored before anything uses them: a second action, or a task run again
    after it, does not ask (and pay) again.  With a ``ledger`` (the URI of a shared folder, or a function that opens
    something with the same two methods) that also holds before: every ``keep_every`` answers are written there, and a task
    that is run again, or a whole job started anew, first reads what is known of its requests and asks
    for the rest: at most ``keep_every`` answers and twice ``parallel`` calls are lost with a task.  Failed calls are not kept.  Requests are dealt to ``partitions`` buckets by their id, and a ledger belongs to
    one number of buckets.
    """
    open_ledger = (lambda: FolderLedger(ledger)) if isinstance(ledger, str) else ledger

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["req_id", "reasoning", "response"], dtype=object)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = open_ledger() if open_ledger is not None else None
        known: dict[int, dict] = {}
        told: list[tuple] = []

        def open_rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if book is not None:
                        if row.bucket not in known:
                            known.clear()  # rows come sorted by bucket
                            known[row.bucket] = book.known(row.bucket)
                        if row.req_id in known[row.bucket]:
                            told.append((row.req_id, *known[row.bucket][row.req_id]))
                            continue
                        bucket_of[row.req_id] = row.bucket
                    yield row.req_id, row.system_prompt, row.prompt

        def keep(rows: list[tuple]) -> pd.DataFrame:
            by_bucket: dict[int, list] = {}
            for row in rows:
                if book is not None:
                    bucket = bucket_of.pop(row[0], None)
                    if bucket is not None and row[2] is not None:
                        by_bucket.setdefault(bucket, []).append(row)
            for bucket, own in by_bucket.items():
                book.add(bucket, own)
            return frame(rows)

        bucket_of: dict[str, int] = {}
        new: list[tuple] = []
        for answer in asked_in_parallel(open_rows(), make_client, parallel):
            new.append(answer)
            if len(new) >= keep_every:
                yield keep(new)
                new = []
            if len(told) >= 1000:
                yield frame(told)
                told.clear()
        yield keep(new)
        yield frame(told)

    bucket = F.pmod(F.xxhash64("req_id"), F.lit(partitions)).cast("int").alias("bucket")
    asked = requests.select("req_id", "system_prompt", "prompt", bucket)
    dealt = asked.repartitionById(partitions, F.col("bucket")).sortWithinPartitions("bucket", "req_id")
    return stored(dealt.mapInPandas(call, TEACHER_ANSWER), "teacher-answers")
