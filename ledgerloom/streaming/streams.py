"""Structured Streaming forms: landing folder, daily volume, feedback averages, result cache (section 2.10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.sources import readers


#: Columns of binary-file sources, which streams must be told.
FILES = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """S4 as a stream: files that appear in a folder, with their status."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(folder)
    return readers.judged_uploads(files)


def ingest(stream: DataFrame, table: str, rejects: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Accepted files go to the transactions table, others to the rejects; batches are replayed whole after a failure."""

    def store_batch(batch: DataFrame, _: int) -> None:
        batch.persist()
        readers.pending_transactions(readers.supported(batch.filter("status = 202")), "2000-01-01").withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(table)
        batch.filter("status <> 202").select("path", "length", "status").write.mode("append").parquet(rejects)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def daily_volume(events: DataFrame, at: str = "created_at", late: str = "2 days") -> DataFrame:
    """A6 as a stream: counts per day, closed once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("completed"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors")
    ).select(F.to_date("w.start").alias("date"), "total", "completed", "errors")


def first_results(results: DataFrame, at: str = "cached_at", ttl: str = "24 hours") -> DataFrame:
    """The result cache as a stream: the first result per content digest within its time to live."""
    return results.withWatermark(at, ttl).dropDuplicatesWithinWatermark(["digest"])


def cache_after(stored: DataFrame, arrived: DataFrame, now: str, ttl: str = "24 hours", size: int = 1000) -> DataFrame:
    """The result cache after a batch: of both tables the rows that still live, the first per digest, and of those the
    ``size`` newest (the oldest insertions go first, ties by digest). Meant for ``foreachBatch``."""
    first = Window.partitionBy("digest").orderBy("cached_at")
    every = stored.unionByName(arrived).filter(F.col("cached_at") > F.expr(f"timestamp '{now}' - interval {ttl}"))
    return every.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").orderBy(F.desc("cached_at"), "digest").limit(size)


def feedback_stream(feedback: DataFrame, group: str = "model", alpha: float = 0.1) -> DataFrame:
    """W8 as a stream: per group the running rates of missed and of false scans, in order of arrival."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, fn, fp = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in frames:
            for predicted, truth in pdf[["predicted", "truth"]].itertuples(index=False):
                n += 1
                if truth == "scanned":
                    fn = alpha * (predicted == "native_pdf") + (1 - alpha) * fn
                elif truth == "native_pdf":
                    fp = alpha * (predicted == "scanned") + (1 - alpha) * fp
        state.update((n, fn, fp))
        yield pd.DataFrame({group: [key[0]], "n": [n], "fn_rate": [fn], "fp_rate": [fp]})

    out = f"{group} string, n long, fn_rate double, fp_rate double"
    return feedback.groupBy(group).applyInPandasWithState(update, out, "n long, fn double, fp double", "update", GroupStateTimeout.NoTimeout)
