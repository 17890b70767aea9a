"""Cutting lineage in the shared folder that the cluster names, and batches of bounded bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch of texts, so that neither the JVM nor Python holds more at once. A session that names a size keeps it.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whether a query's shuffles are deleted when it ends. Else they stay until the driver collects garbage, which a large heap seldom does.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a local session gets a temporary one; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _no_shuffle_stays(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stash(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The copy survives lost executors and is read by column, which checkpoint() is not. What was shuffled
    for it is deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"
    with _no_shuffle_stays(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same, bucketed by ``key``: what groups or joins the copy by it reads it without a shuffle."""
    spark = df.sparkSession
    table = f"attesta_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table.replace('_', '-')}"
    with _no_shuffle_stays(spark):
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    copy = spark.table(table)
    copy.schema  # noqa: B018  resolved now: the name is not needed any more
    spark.sql(f"DROP TABLE {table}")
    return copy


def discard(*stashes: DataFrame) -> None:
    """Delete the files of stashes that nothing reads any more."""
    for df in stashes:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rpartition("/")[0] for f in df.inputFiles() if "/attesta-" in f}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def _give_back() -> None:
    """Hand free memory back to the system: a worker that runs on would keep the most that any task before needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_batches(df: DataFrame, task, schema) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_BYTES`` (and of the session's number of rows) at most; memory goes back after each task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)
