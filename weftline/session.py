"""Session helpers: the shared folder and tables stored between stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; it has to be set, also in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: folders of stage tables that this process has written and not yet removed
_STAGES: list[str] = []


def remove_stages(spark: SparkSession, paths: Sequence[str] | None = None) -> int:
    """Delete stage tables, all that were written so far or those of ``paths``; to be called once a job's output is complete.

    DataFrames that start from them can no longer be used.  Returns how many there were.
    """
    removed = 0
    for own in list(_STAGES if paths is None else paths):
        if own in _STAGES:
            _STAGES.remove(own)
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


@contextmanager
def stage_tables() -> Iterator[list[str]]:
    """Collects the folders of the stage tables that are written inside, for ``remove_stages``."""
    before, made = set(_STAGES), []
    yield made
    made += [path for path in _STAGES if path not in before]


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: the stage boundary.

    What follows starts from files, so a lost executor repeats nothing before this
    point.  The size of the files is known when the next join is planned: a side
    below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, a larger one shuffled.

    With ``by`` the table is bucketed on that key, one file per bucket and as many buckets
    as shuffle partitions.  Requests kept this way are joined to every lot of
    answers without moving their texts again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    _STAGES.append(path)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    bucketed = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
    bucketed.option("path", path).saveAsTable(table)
    return spark.table(table)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was finished, not only begun."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in one step; false if the target is there already."""
    hadoop = spark._jvm.org.apache.hadoop
    context = hadoop.fs.FileContext.getFileContext(
        hadoop.fs.Path(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    no_overwrite = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    no_overwrite[0] = hadoop.fs.Options.Rename.NONE
    try:
        context.rename(hadoop.fs.Path(source), hadoop.fs.Path(target), no_overwrite)
    except Py4JJavaError as error:
        kind = error.java_exception.getClass().getSimpleName()
        if kind in ("FileAlreadyExistsException", "FileNotFoundException") or _exists(spark, target):
            return False
        raise
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def _touch(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).create(own).close()


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def write_once(
    spark: SparkSession, path: str, write: Callable[[str], None], force: bool = False
) -> bool:
    """Let ``write`` make the folder ``path``, once: false if another write was first, whose folder then stays.

    ``write`` is given a folder aside, which is renamed when it is complete.  The rename is one step that fails where the folder
    is already there, so of several drivers that write at the same time one wins as a whole, and
    nobody reads half of one and half of the other.  What is left of a write that was cut off does not count: it is moved aside
    and deleted.  With ``force`` a complete folder is replaced as well; readers of the old one have to be done.
    Needs a file system with an atomic rename (HDFS, a local or mounted folder), not a bare object store.
    """
    path = path.rstrip("/")
    if not force and is_complete(spark, path):
        return False
    name = uuid.uuid4().hex
    aside = f"{path}.new-{name}"
    write(aside)
    _touch(spark, f"{aside}/_writer-{name}")
    while True:
        if _move(spark, aside, path):
            if _exists(spark, f"{path}/_writer-{name}"):
                return True
            # a local file system, where another folder has come up since the rename looked, copies into that
            _delete(spark, f"{path}/{aside.rsplit('/', 1)[-1]}")
            return False
        if not force and is_complete(spark, path):
            _delete(spark, aside)
            return False
        old = f"{path}.old-{uuid.uuid4().hex}"
        if _move(spark, path, old):
            if not force and is_complete(spark, old) and _move(spark, old, path):
                _delete(spark, aside)  # another driver was done in between: its folder is put back
                return False
            _delete(spark, old)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], *plain: str) -> DataFrame:
    """Inner join on equal ``keys`` where two nulls are equal, with the keys of the left.

    ``plain`` names further keys that are never null.
    """
    both = [*keys, *plain]
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in both})
    condition = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    condition += [F.col(k) == F.col(f"_same_{k}") for k in plain]
    return left.join(renamed, condition).drop(*[f"_same_{k}" for k in both])
