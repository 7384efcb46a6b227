"""Keyed state on streams: attempts of each key, with a timer for those that stall, and tables that are counted and joined as time passes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that keyed processors need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ATTEMPT = "uuid string, state string, attempts long, seen long, failures array<long>"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """A query that starts within has the store that keyed processors need; it keeps the settings that it starts with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Attempts(StatefulProcessor):
    """The state of each key from its events (uuid, kind, seq, ts), whatever order they come in.

    Completed wins; failures count; a start that is later than any end is in progress, or stalled once ``stall_ms`` of event time have passed since.
    The sequence numbers of the failures are kept until the key completes. All of a key's state is one value, as each call to the store is a message to the JVM:
    a key of a batch costs two, whatever its rows, and timers are asked for only where stalls are.
    """

    def __init__(self, most_attempts: int, stall_ms: int) -> None:
        self.most_attempts, self.stall_ms = most_attempts, stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "done boolean, attempts long, last_start long, started_ms long, last_end long, seen long, failures array<long>")

    def _state(self, done: bool, attempts: int, last_start: int, last_end: int) -> str:
        if done:
            return "completed"
        if attempts >= self.most_attempts:
            return "failed"
        return "in_progress" if last_start > last_end else "retry"

    def _row(self, key: tuple, state: str, done: bool, attempts: int, seen: int, failures: list[int]) -> Row:
        return Row(uuid=key[0], state=state, attempts=0 if done else attempts, seen=seen, failures=sorted(failures))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        done, attempts, last_start, started, last_end, seen, before = self.now.get() or (False, 0, -1, -1, -1, 0, ())
        failed = []
        for _, kind, seq, _, ms in rows:
            seen += 1
            if kind == "started":
                if seq > last_start:
                    last_start, started = seq, ms
            elif kind in ("completed", "failed"):
                last_end = max(last_end, seq)
                done = done or kind == "completed"
                if kind == "failed":
                    failed.append(seq)
        attempts += len(failed)
        failures = [] if done else [*before, *failed]
        self.now.update((done, attempts, last_start, started, last_end, seen, failures))
        state = self._state(done, attempts, last_start, last_end)
        if self.stall_ms:  # else there are no timers
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state == "in_progress":
                self.handle.registerTimer(max(started + self.stall_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, state, done, attempts, seen, failures)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        done, attempts, _, _, _, seen, failures = self.now.get()
        yield self._row(key, "stalled", done, attempts, seen, list(failures))

    def close(self) -> None:
        pass


def attempt_states(events: DataFrame, most_attempts: int, stall: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream of events (uuid, kind, seq, ts) to a stream of states (uuid, state, attempts, seen, failures): a row for each key that a batch changes.

    ``seen`` counts the key's events, so a key's last row has the most. With ``stall``, an interval such as ``2 hours``, keys still in progress
    that long after their start, by the watermark, get a row that says ``stalled``. State is kept in the query's checkpoint and goes on after a restart.
    """
    stall_ms = int(pd.Timedelta(stall).total_seconds() * 1000) if stall else 0
    rows = events.select(F.col("uuid").cast("string").alias("uuid"), "kind", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.select("uuid", "kind", "seq", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("uuid").transformWithState(statefulProcessor=Attempts(most_attempts, stall_ms), outputStructType=_ATTEMPT, outputMode="Update", timeMode="EventTime")


def latest_states(log: DataFrame) -> DataFrame:
    """The last state of each key in what ``attempt_states`` has given; a stall comes after the state that it ends."""
    order = F.struct("seen", F.col("state") == "stalled")
    return log.groupBy("uuid").agg(F.max_by(F.struct("state", "attempts", "failures"), order).alias("r")).select("uuid", "r.*")


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Each batch's rows as a folder of its own under ``path``; a batch that is run again replaces its folder."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:05d}")

    with keyed_store(stream.sparkSession):
        return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_windows(stream: DataFrame, column: str, size: str, late: str, path: str, checkpoint: str) -> StreamingQuery:
    """Counts by window of a stream whose rows may be late, appended to ``path``; (window_start, n, batch), the last batch's count being a window's.

    The watermark is the greatest time of a batch and those before less ``late``. A row is dropped if its window is closed: it had ended by the watermark with
    which the batch before the row's own was run.
    """
    counts = stream.withWatermark(column, late).groupBy(F.window(column, size).alias("w")).agg(F.count("*").alias("n"))
    return append_batches(counts.select(F.col("w.start").alias("window_start"), "n"), path, checkpoint)


def kept_counts(log: DataFrame) -> DataFrame:
    """The last count of each window in what ``counted_windows`` has given."""
    return log.groupBy("window_start").agg(F.max_by("n", "batch").alias("n"))


def interval_joined(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Rows of two streams of one key where the right one comes at or after the left one and ``within`` of it; both sides' state ends with the watermark."""
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    near = (F.col(f"b.{right_time}") >= F.col(f"a.{left_time}")) & (F.col(f"b.{right_time}") <= F.col(f"a.{left_time}") + F.expr(f"interval {within}"))
    return a.alias("a").join(b.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)
