"""Helpers shared by the corpus operators: the shared folder, text clean-up, grouped streaming over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder, ship_package

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`stash` writes inside are deleted at the end; what is still needed must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; the innermost :func:`scratch` deletes it."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of ids or keys is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Plain ASCII takes the fast built-in; other texts are translated letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python workers in batches of at most ``rows`` documents, which bounds a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trim_memory() -> None:
    """Give freed memory back to the system: workers are reused, and each would keep the peak of every stage before."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def collect_garbage(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage, one task a core: else a heap that grew in one stage stays as large
    beside the Python workers of the next ones, though little of it is alive."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


#: What workers keep between tasks, by the operator that it belongs to: how to let go of it.
CACHES: dict[str, Callable[[], None]] = {}


def release(but: str | None = None) -> None:
    """Empty the caches of all operators but one: a worker that serves another one holds nothing of those before."""
    for name, clear in CACHES.items():
        if name != but:
            clear()


def trimmed(fn: Callable, cache: str | None = None) -> Callable:
    """``fn`` of one or two tables, with :func:`trim_memory` after each call; its parameters stay as they are, since Spark
    counts them."""

    def one(a):
        release(cache)
        try:
            return fn(a)
        finally:
            trim_memory()

    def two(a, b):
        release(cache)
        try:
            return fn(a, b)
        finally:
            trim_memory()

    return one if fn.__code__.co_argcount == 1 else two


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache: str | None = None) -> Callable:
    """``run`` over a task's batches; the worker lets go of other operators' caches before and of freed memory after."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(cache)
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return task


def by_group(
    df: DataFrame, key: str, fn: Callable[[int, pa.Table], pa.RecordBatch | None], schema: str, n: int | None = None
) -> DataFrame:
    """Apply ``fn(key, rows)`` to all rows of each value of the non-null long column ``key``.

    One shuffle by key, then a sorted stream per task: many small groups cost one Arrow batch, not one call each;
    a group is held whole, so callers bound group sizes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                k = int(keys[a])
                if held and k != last:
                    if (out := fn(last, pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = k
        if held and (out := fn(last, pa.Table.from_batches(held))) is not None:
            yield out

    ship_package(df.sparkSession)
    dealt = df.repartition(key) if n is None else df.repartition(n, key)
    return dealt.sortWithinPartitions(key).mapInArrow(lean(run), schema)
