"""Keyed state with timers, versioned tables, and delivery where writes and uploads break off."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspan.sources import delivery, directory, sinks, versions
from quillspan.streaming import ingest, state

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "uuid string, kind string, seq long, ts timestamp"


def put(spark, path, rows):
    spark.createDataFrame([(u, k, s, T0 + dt.timedelta(minutes=s)) for u, k, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, stall):
    stream = state.attempt_states(ingest.file_stream(spark, f"{tmp}/in", SCHEMA, 1), 2, stall, "1 minute")
    ingest.run_to_end(state.append_batches(stream, f"{tmp}/out", f"{tmp}/checkpoint"))
    return {r.uuid: (r.state, r.attempts, r.failures) for r in state.latest_states(spark.read.parquet(f"{tmp}/out")).collect()}


def test_attempts_stall_by_event_time_and_go_on_after_a_restart(spark, tmp_path):
    tmp = f"file://{tmp_path}"
    put(spark, f"{tmp}/in", [("a", "started", 1), ("b", "failed", 3), ("b", "started", 2), ("c", "completed", 2), ("c", "failed", 1)])
    assert run(spark, tmp, "1 hour") == {"a": ("in_progress", 0, []), "b": ("retry", 1, [3]), "c": ("completed", 0, [])}
    put(spark, f"{tmp}/in", [("b", "failed", 100), ("d", "started", 101)])
    put(spark, f"{tmp}/in", [("d", "other", 102)])
    got = run(spark, tmp, "1 hour")
    assert got == {"a": ("stalled", 0, []), "b": ("failed", 2, [3, 100]), "c": ("completed", 0, []), "d": ("in_progress", 0, [])}
    put(spark, f"{tmp}/in", [("a", "completed", 103)])
    assert run(spark, tmp, "1 hour")["a"] == ("completed", 0, [])


class Calls:
    """A state handle that counts what it is asked."""

    def __init__(self):
        self.made, self.value = [], None

    def __getattr__(self, name):
        def call(*args):
            self.made.append(name)
            if name == "update":
                self.value = args[0]
            return self if name.endswith("State") else self.value if name == "get" else []

        return call


def test_a_key_of_a_batch_costs_two_calls_to_the_store():
    handle, machine = Calls(), state.Attempts(9, 0)
    machine.init(handle)
    for batch in ([("started", 1), ("failed", 2), ("failed", 5)], [("failed", 3), ("other", 4), ("started", 6)]):
        handle.made.clear()
        (got,) = machine.handleInputRows(("k",), iter([("k", kind, seq, None, seq * 1000) for kind, seq in batch]), None)
        assert handle.made == ["get", "update"]
    assert tuple(got) == ("k", "in_progress", 3, 6, [2, 3, 5])


def test_broken_write_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    assert versions.current(spark, path) is None and versions.folders(spark, path) == []
    versions.swap(spark, path, lambda folder: spark.range(5).write.parquet(folder))

    def breaks(folder):
        spark.range(9).coalesce(1).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")).write.parquet(folder)

    with pytest.raises(Exception, match="lost"):
        versions.swap(spark, path, breaks)
    assert versions.read(spark, path).count() == 5 and versions.current(spark, path)["version"] == 0
    there = [f"{path}/{p.name}" for p in (tmp_path / "table").iterdir()]
    assert len(versions.unused(spark, path, there)) == len(there) - 2
    versions.swap(spark, path, lambda folder: spark.range(3).write.parquet(folder))
    assert versions.read(spark, path).count() == 3 and versions.current(spark, path)["version"] == 1


def test_changes_stay_few_and_batches_may_be_run_again(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    last = {}
    for n in range(7):
        rows = [(k, 10 * n + k, f"v{n}") for k in range(n, n + 3)] + [(n, 10 * n + 9, "later")]
        for k, s, v in rows:
            last[k] = v if s >= 0 else None
        versions.upsert(spark.createDataFrame(rows, "k long, s long, v string"), path, ["k"], "s", n, every=3)
        assert len(versions.folders(spark, path)) <= 3
    before = versions.current(spark, path)
    versions.upsert(spark.createDataFrame([(0, 999, "again")], "k long, s long, v string"), path, ["k"], "s", 6, every=3)
    assert versions.current(spark, path) == before
    assert {r.k: r.v for r in versions.read(spark, path, ["k"], "s").collect()} == last


def fails_on_odd(row, attempt):
    if row["id"] % 2:
        raise OSError("odd")


def test_delivery_counts_only_what_was_committed(spark, tmp_path):
    path = f"file://{tmp_path}/status"
    assert delivery.statuses(spark, path).count() == 0
    files = spark.range(10).repartition(3)
    broken = files.select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        delivery.deliver(broken, "test_streams:fails_on_odd", path, 2, 0.0)
    assert delivery.statuses(spark, path).count() == 0
    delivery.deliver(files, "test_streams:fails_on_odd", path, 2, 0.0)
    delivery.deliver(delivery.retries(files, "id", delivery.statuses(spark, path)), "builtins:print", path, 1, 0.0)
    got = {int(r.file_id): (r.status, r.attempts, r.error) for r in delivery.statuses(spark, path).collect()}
    assert got == {i: ("uploaded", 1, None) for i in range(10)}


def test_writer_tries_again_with_longer_waits(monkeypatch, tmp_path):
    from pyspark.sql import Row

    waits, tries = [], []
    monkeypatch.setattr(delivery.time, "sleep", waits.append)
    writer = delivery.DeliveryWriter({"upload": "x:y", "status": f"file://{tmp_path}", "attempts": "4", "backoff_seconds": "0.5"})

    def third_time(row, attempt):
        tries.append(attempt)
        if attempt < 3:
            raise OSError("busy")

    assert writer._deliver(third_time, Row(id=1)) == {"file_id": "1", "status": "uploaded", "attempts": 3, "error": None}
    assert tries == [1, 2, 3] and waits == [0.5, 1.0]


def test_paged_stream_reads_all_pages_after_a_restart(spark, tmp_path):
    """More pages come before the restart's only batch than the source once let a batch have."""
    directory.register(spark)
    root = f"file://{tmp_path}"
    for first, end in ((0, 2), (2, 1102)):
        sinks.named_files(spark.range(first, end).select(F.format_string("page=%d/part-0.json", "id").alias("path"), F.format_string('{"id": %d}', "id").alias("content")), f"{root}/in")
        read = spark.readStream.format("paged").schema("id long").option("fetch", "quillspan.sources.directory:stored_page").option("count", "quillspan.sources.directory:stored_pages")
        ingest.run_to_end(state.append_batches(read.option("root", f"{root}/in").load(), f"{root}/out", f"{root}/checkpoint", "append"))
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").collect()) == list(range(1102))
