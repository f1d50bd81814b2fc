"""Shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None
_written: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir`` or by ``setCheckpointDir``.

    Only where neither is set and the master is local, as in a test, a temporary folder stands
    in; it goes away with the process. On a cluster that would leave each executor's files on
    its own disk, so it is an error there.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    chosen = context.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="matchloom-")
    return _local_folder.name


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/matchloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back.

    Cuts the lineage in a way that survives the loss of executors, and gives the
    optimizer the true size of the result.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove what ``materialize`` writes inside, once the result is stored elsewhere."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in whatever store they are; sorted."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().toString() for f in found or ())


def make_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder within its store; the parent of the target is made if it is missing."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(new(to).getParent())
    if not store.rename(new(path), new(to)):
        raise OSError(f"{path} could not be moved to {to}")


def cell_partitions(spark: SparkSession, cells: int) -> int:
    """Partitions for a number of equal cells.

    Twice as many as cells, so that few cells share a partition, but never more than
    the cluster is set up for; a partition may well hold many cells. The number is
    explicit because adaptive execution would merge tasks that are small in bytes
    and large in work.
    """
    limit = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                8 * spark.sparkContext.defaultParallelism)
    return max(1, min(2 * cells, limit))
