"""Helpers that several operators use: tables, checkpoints and stable buckets."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy(run):
    """``run`` (batches to batches), after which the worker hands freed memory back: workers stay for later tasks, side by side with new ones."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local_dir(spark: SparkSession) -> str:
    """A folder of this machine, which only a local session may share."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/cohortspark-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (as in local tests) is one set here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_already = spark.sparkContext.getCheckpointDir()
        found = set_already or _local_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder once and survive lost executors."""
    return saved(df, "cut")


def temporary(spark: SparkSession, path: str) -> None:
    """Have Hadoop remove the folder when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them again (columnar, so later reads can prune); the files last as long as the application."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    temporary(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``saved`` table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def own_session(spark: SparkSession, batch_rows: int) -> SparkSession:
    """A session with the same settings but ``batch_rows`` rows in an Arrow batch, in which every query's shuffle files go at its end; for steps that save what they make and read it once."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def handed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A ``saved`` table, in another session."""
    out = spark.read.schema(df.schema).parquet(df._written_to)
    out._written_to = df._written_to
    return out


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
