"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session may lack the setting; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/spark-veriloom-{spark.sparkContext.applicationId}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand Python at most ``rows`` rows at a time, which bounds its memory."""
    with setting(spark, ARROW_ROWS, rows):
        yield


#: Spark removes a job's shuffle files at its end, since its result is a table that outlives them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: What the scopes around a job have written, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside go at the end, whether it is reached or not."""
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        removed(spark, *made)


def written(df: DataFrame, name: str, rows: int = 2000, parts: int | None = None, outside: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut.

    ``parts`` is the most files it gets, for tables whose size is known.  A table for
    use ``outside`` the innermost scope belongs to the one around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veriloom/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()[: -1 if outside else None]
    if scopes:
        scopes[-1].append(path)
    with setting(spark, ARROW_ROWS, rows), setting(spark, CLEANUP, "true"):
        (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(rows: int, each: int = 100_000) -> int:
    """Files for a table of so many narrow rows."""
    return max(1, -(-rows // each))


def folders(table: DataFrame) -> set[str]:
    """The folders of the files that ``table`` reads."""
    return {file.rsplit("/", 1)[0] for file in table.inputFiles()}


def removed(spark: SparkSession, *paths: str) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discarded(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and no later step reads."""
    for table in tables:
        removed(table.sparkSession, *folders(table))


def releasing(run: Callable) -> Callable:
    """A task function that hands memory back to the system when its task ends.

    Python workers outlive tasks; what their allocators keep would count against
    the executor in the stages that follow.
    """

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: Column | str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % divisor


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_hot(df: DataFrame, key: list[str], per_key: DataFrame, count: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join ``df`` with one row per key, safely for a key that holds much of ``df``.

    Keys whose ``count`` is at least ``total / parts`` number at most ``parts``, so
    they are broadcast; every other key has fewer rows and joins by shuffle.
    A null-safe comparison is not needed: callers' keys are never null.
    """
    limit = max(1, total // parts)
    hot = per_key.where(F.col(count) > limit)
    rest = per_key.where(F.col(count) <= limit)
    values = [c for c in per_key.columns if c not in key]
    marked = df.join(F.broadcast(hot.select(*key, F.struct(*values).alias("_hot"))), key, "left")
    # rows of hot keys are spread by their own hash, which meets nothing in the shuffled join
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.xxhash64(*df.columns).bitwiseOR(F.lit(1)))
    met = marked.withColumn("_s", spread).join(rest.withColumn("_s", F.lit(0).cast("long")), [*key, "_s"], "left")
    return met.select(*df.columns, *[F.coalesce(F.col("_hot")[c], F.col(c)).alias(c) for c in values])


#: Rows of at most some hundred bytes that may be broadcast; beyond that a join shuffles.
FEW = 200_000


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` but for the rows whose id is in ``rejected``."""
    side = few(written(rejected.select(F.col(id_col).alias("_id")).distinct(), "rejected"))
    return docs.join(side, F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
