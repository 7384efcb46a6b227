"""Structured Streaming: incremental ingest, micro-batch shards, keyed state, and event-time windows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, pattern: str = "*.parquet", format: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; ``files_per_trigger`` bounds a batch, which is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).format(format).load(path)


def event_time(df: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Naive timestamps as UTC instants with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed(df: DataFrame, column: str, size: str, slide: str | None, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Tumbling (no slide) or sliding windows, the same plan for batch and stream."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    out = df.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, column: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    out = df.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def write_shards(stream: DataFrame, path: str, checkpoint: str, rows: int) -> StreamingQuery:
    """Each micro-batch becomes one shard folder named by its batch id; a replayed batch overwrites its own shard."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path}/shard={batch_id:05d}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_pending(pending: DataFrame, done: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None]) -> None:
    """Resume: only keys that are not done are worked on, and results are appended."""
    sink(work(pending.join(done.select(key), key, "left_anti")))


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_until(start: Callable[[Callable[[int], None]], StreamingQuery], rows: int | None = None, stop: Callable[[], bool] | None = None, poll_seconds: float = 0.5) -> int:
    """Runs a query until it ends, has taken ``rows`` rows, or ``stop`` says so between batches; how many rows it took.

    ``start`` starts the query and is given what each batch has to call with its number of rows. A batch is never cut: the one that reaches the budget is finished, and
    the next run goes on after it from the checkpoint.
    """
    taken = 0

    def took(n: int) -> None:
        nonlocal taken
        if rows is not None and taken >= rows or stop is not None and stop():
            raise _Enough
        taken += n

    query = start(took)
    while query.isActive:
        time.sleep(poll_seconds)
        if query.isActive and not query.status["isTriggerActive"] and (rows is not None and taken >= rows or stop is not None and stop()):
            query.stop()  # it waits for input
    error = query.exception()
    if error is not None and _Enough.__name__ not in str(error):
        raise RuntimeError(str(error))
    return taken


class _Enough(Exception):  # noqa: N818
    """A batch that comes after the last one wanted; it stays unread for the next run."""


def retry_selection(manifests: DataFrame, most: int) -> DataFrame:
    """Captured files whose upload is not complete, oldest first, at most ``most``."""
    done = F.coalesce(F.col("gcs.audio_upload.ok"), F.lit(False)) & F.coalesce(F.col("gcs.metadata_upload.ok"), F.lit(False))
    return manifests.where(~done).orderBy("capture.started_at", "local.metadata_path").limit(most)


def package_every(stream: DataFrame, path: str, checkpoint: str, every: int, package: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Appends each micro-batch as processed records and, after every ``every`` batches, packages all records so far."""

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:05d}")
        if (batch_id + 1) % every == 0:
            package(batch.sparkSession.read.parquet(path), batch_id)

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_callback(stream: DataFrame, checkpoint: str, done: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``done(results, batch_id)`` for results as they complete, a micro-batch at a time."""
    return stream.writeStream.foreachBatch(done).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
