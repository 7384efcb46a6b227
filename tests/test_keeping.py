"""The table store, counted writes, spot checks, and streams that are stopped."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspan.operators import rank as R
from quillspan.operators import reports as P
from quillspan.operators import rules
from quillspan.operators import signal as G
from quillspan.sources import sinks, versions
from quillspan.sources.store import Store, Table
from quillspan.streaming import ingest

TABLES = {
    "a": Table("k long, v string, seq long", ("k",), "seq"),
    "b": Table("k long, who string, seq long", ("k", "who"), "seq", "a", "k"),
    "c": Table("k long, who string, n int, seq long", ("k", "who"), "seq", "b", "who"),
}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_deletes_in_depth_and_refuses_orphans(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", {n: TABLES[n] for n in "ab"})
    assert store.create() == ["a", "b"] and store.create() == [] and store.rows("a").isEmpty()
    store.upsert("a", spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", 1)], TABLES["a"].schema))
    store.upsert("a", spark.createDataFrame([(2, "new", 2), (3, "old", 0)], TABLES["a"].schema))
    assert rows(store.rows("a").select("k", "v")) == [(1, "x"), (2, "new"), (3, "z")]
    store.upsert("b", spark.createDataFrame([(1, "p", 1), (2, "p", 1), (2, "q", 1)], TABLES["b"].schema))
    with pytest.raises(ValueError, match="no row of a"):
        store.upsert("b", spark.createDataFrame([(9, "p", 1)], TABLES["b"].schema))
    store.delete("a", spark.createDataFrame([(2,), (7,)], "k long"))
    assert rows(store.rows("a").select("k")) == [(1,), (3,)] and rows(store.rows("b").select("k", "who")) == [(1, "p")]
    store.clear("a")
    assert store.rows("a").isEmpty() and store.rows("b").isEmpty()


def test_migration_adds_columns_once(spark, tmp_path):
    path = f"file://{tmp_path}"
    old = Store(spark, path, {"a": Table("k long, seq long", ("k",), "seq")})
    old.create()
    old.upsert("a", spark.createDataFrame([(1, 1)], "k long, seq long"))
    new = Store(spark, path, {"a": TABLES["a"]})
    assert new.migrate({"v": F.lit("none")}) == ["a"] and new.migrate() == []
    assert rows(new.rows("a").select("k", "v")) == [(1, "none")]
    new.upsert("a", spark.createDataFrame([(1, "x", 2)], TABLES["a"].schema))
    assert rows(new.rows("a").select("k", "v")) == [(1, "x")] and versions.current(spark, f"{path}/a")["batch"] == 1


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    read = []
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100, numPartitions=4).mapInArrow(look, "id long")
    asked = [("small", F.col("id") < 10), (F.concat(F.lit("odd "), "id"), F.col("id") % 2 == 1), ("never", F.lit(None).cast("boolean"))]
    got = sinks.write_counted(df, asked, str(tmp_path / "out"), ["small", "odd", "never"])
    read = spark.read.parquet(str(tmp_path / "out"))
    assert got == {"small": 10, "odd": 45, "never": 0, "kept": 45} and read.count() == 45 and read.columns == ["id"]
    assert seen.value == 100  # the input was read once
    assert {r.drop_reason.split()[0]: 1 for r in rules.reason_counts(spark.range(100), asked).collect()} == {"small": 1, "odd": 1, "kept": 1}
    with pytest.raises(ValueError, match="needs a name"):
        sinks.write_counted(df, asked, str(tmp_path / "no"))


def test_spot_check_rows(spark):
    said = [("k1", "x", "<|joy|> one two three", "<|joy|> one two three"), ("k2", "x", "<|joy|> one two three four", "<|fear|> one two"), ("k3", "x", "a", ""), ("k4", "y", "", "")]
    got = P.spot_check(spark.createDataFrame(said, "k string, l string, r string, p string"), "k", "l", "r", "p", 5, 1).collect()
    assert [(r.l, r.k, r.wer, r.bucket, r.leading, r.predicted, r.is_right) for r in got] == [
        ("x", "k3", 1.0, "poor", None, None, True), ("x", "k2", 0.5, "poor", "<|joy|>", "<|fear|>", False), ("x", "k1", 0.0, "good", "<|joy|>", "<|joy|>", True), ("y", "k4", 0.0, "good", None, None, True),
    ]
    many = spark.range(40).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("string").alias("l"), F.lit("a b").alias("r"), F.lit("a").alias("p"))
    assert {r.l: r.n for r in P.spot_check(many, "k", "l", "r", "p", 3, 1).groupBy("l").agg(F.count("*").alias("n")).collect()} == {"0": 3, "1": 3}


def test_positions_of_two_tables_and_kept_orders(spark):
    a, b = spark.createDataFrame([("x", 3), ("y", 1), ("z", 2)], "a string, o int"), spark.createDataFrame([(7,), (5,)], "b int")
    assert [(r.a, r.b) for r in R.zipped(a, b, [F.col("o")], [F.col("b")]).orderBy("pos").collect()] == [("y", 5), ("z", 7), ("x", None)]
    chosen = spark.createDataFrame([("z", 0), ("x", 1), ("z", 2), ("none", 3)], "a string, place int")
    assert [(r.place, r.a) for r in R.restored(a, chosen, "a", "place").collect()] == [(0, "z"), (1, "x"), (2, "z")]
    counted = R.by_count(spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string"), "v")
    assert [(r.v, r.n, r.place) for r in counted.orderBy("place").collect()] == [("c", 2, 0), ("a", 1, 1), ("b", 1, 2)]


def test_cut_plan(spark):
    df = spark.createDataFrame([("a", 65.0), ("b", 30.0), ("c", 0.0), ("d", None), ("e", 0.5)], "k string, s double")
    assert rows(G.cut_plan(df, ["k"], "s", 30.0)) == [("a", 0, 0.0, 30.0), ("a", 1, 30.0, 60.0), ("a", 2, 60.0, 65.0), ("b", 0, 0.0, 30.0), ("e", 0, 0.0, 0.5)]


def test_stop_signal_between_batches(spark, tmp_path):
    """A query that would wait for more input ends once it is told to, and leaves what has not begun to the next run."""
    for i in range(3):
        spark.range(i * 10, i * 10 + 10, numPartitions=1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []

    def start(took):
        def put(batch, batch_id):
            took(batch.count())
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")
            told.append(batch_id)

        stream = ingest.file_stream(spark, f"{tmp_path}/in", "id long", 1)
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="100 milliseconds").start()

    assert ingest.run_until(start, stop=lambda: len(told) >= 1) == 10 and told == [0]
    assert ingest.run_until(start, stop=lambda: len(told) >= 3) == 20
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(30))


def test_checkpoint_document_is_json_in_versions(spark, tmp_path):
    import json

    from quillspan.operators import labels as L
    from quillspan.sources import readers

    path = f"file://{tmp_path}/checkpoint"
    events = [('a"b\\', "completed", 1), ("ü", "completed", 2), ("c", "failed", 1), ("d", "failed", 1), ("d", "failed", 2), ("e", "started", 1), ("f", "started", 2)]
    state = L.checkpoint_state(spark.createDataFrame(events, "uuid string, kind string, seq long"), 2)
    results = spark.createDataFrame([('a"b\\', "x/1", 2.5), ("ü", "line\nbreak", None)], "uuid string, filepath string, duration_actual double")
    none = state.limit(0), results.limit(0)
    sinks.write_checkpoint(*none, path, "then")
    assert readers.checkpoint(spark, path).isEmpty()
    sinks.write_checkpoint(state, results, path, "now", {"max_retries": 2})
    text = "".join(r.value + "\n" for r in spark.read.text(versions.folders(spark, path)).collect())
    assert json.loads(text) == {
        "completed": {'a"b\\': {"filepath": "x/1", "duration_actual": 2.5}, "ü": {"filepath": "line\nbreak"}}, "failed": {"c": {"attempts": 1}, "d": {"attempts": 2}},
        "in_progress": ["e", "f"], "started_at": "now", "config": {"max_retries": 2},
    }
    assert {r.uuid: (r.filepath, r.duration_actual) for r in readers.checkpoint(spark, path).collect()} == {'a"b\\': ("x/1", 2.5), "ü": ("line\nbreak", None)}
