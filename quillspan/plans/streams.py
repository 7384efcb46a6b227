"""Streams with keyed state, late rows and joins in time; delivery, paged services and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.rank import positions
from quillspan.plans.registry import query, table
from quillspan.plans.relational import _KIND_SQL, _STATE_SQL, checkpoint_events
from quillspan.scratch import fresh
from quillspan.sources import delivery, directory, sinks, versions
from quillspan.streaming import ingest, state


def in_files(df: DataFrame, path: str, batch: str, batches: int) -> None:
    """One file after another, in the order in which a stream will find them."""
    for i in range(batches):
        df.where(F.col(batch) == i).drop(batch).coalesce(1).write.mode("append").parquet(path)


def _stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return ingest.file_stream(spark, path, schema, 1)


@query("streamed_attempts", f"select uuid, {_KIND_SQL} as state, case when done = 1 then 0 else attempts end as attempts from {_STATE_SQL}")
def streamed_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The state machine over a stream in four files, stopped after two and started again from its checkpoint."""
    path = fresh(spark, "attempts")
    events = checkpoint_events(spark, d).withColumn("part", F.col("seq") % 4)
    schema = "uuid string, kind string, seq long, ts timestamp_ntz"
    for half in (0, 1):
        in_files(events.where(F.floor(F.col("part") / 2) == half).withColumn("part", F.col("part") % 2), f"{path}/in", "part", 2)
        stream = state.attempt_states(_stream(spark, f"{path}/in", schema), 12, late="400 days")
        ingest.run_to_end(state.append_batches(stream, f"{path}/out", f"{path}/checkpoint"))
    return state.latest_states(spark.read.parquet(f"{path}/out")).select("uuid", "state", "attempts")


_ARRIVAL = """
a as (select ts, value, case when event_id % 10 = 0 then 3 else cast(floor((row_number() over (order by ts, event_id) - 1) * 4 / count(*) over ()) as int) end as batch from events),
w as (select batch, time_bucket(interval 6 hour, ts, timestamp '2024-01-01') as start, coalesce((select max(b.ts) from a b where b.batch < a.batch - 1) - interval 1 day, timestamp '1970-01-01') as mark from a)"""


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events in four batches by time, but for every tenth, which comes in the last."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    n = events.agg(F.count("*")).scalar()
    placed = positions(events, [F.col("ts"), F.col("event_id")])
    return placed.select("event_id", "ts", F.when(F.col("event_id") % 10 == 0, 3).otherwise(F.floor(F.col("pos") * 4 / n)).cast("int").alias("part"))


def _late(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Arrivals, and the windows' counts of a stream of them."""
    path = fresh(spark, "late")
    rows = _arrivals(spark, d)
    in_files(rows, f"{path}/in", "part", 4)
    ingest.run_to_end(state.counted_windows(_stream(spark, f"{path}/in", "event_id long, ts timestamp"), "ts", "6 hours", "1 day", f"{path}/out", f"{path}/checkpoint"))
    return rows, state.kept_counts(spark.read.parquet(f"{path}/out"))


@query("late_windows", f"with {_ARRIVAL} select strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n from w where date_trunc('millisecond', mark) < start + interval 6 hour group by 1")
def late_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts by window of what came in time."""
    return _late(spark, d)[1].select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("late_dropped", f"with {_ARRIVAL} select count(*) as arrived, count(*) filter (where date_trunc('millisecond', mark) < start + interval 6 hour) as kept, count(*) filter (where date_trunc('millisecond', mark) >= start + interval 6 hour) as dropped from w")
def late_dropped(spark: SparkSession, d: str) -> DataFrame:
    """How many rows came too late to be counted."""
    rows, counts = _late(spark, d)
    kept = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return rows.agg(F.count("*").alias("arrived")).withColumn("kept", kept).withColumn("dropped", F.col("arrived") - F.col("kept"))


@query("streamed_pairs", """
select v.event_id as view_id, e.event_id as error_id from events v join events e on e.user_id = v.user_id and e.ts >= v.ts and e.ts <= v.ts + interval 2 hour where v.event_type = 'view' and e.event_type = 'error'""")
def streamed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Errors within two hours of a view of the same user, joined as two streams."""
    path = fresh(spark, "pairs")
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    n = events.agg(F.count("*")).scalar()
    in_files(positions(events, [F.col("ts"), F.col("event_id")]).withColumn("part", F.floor(F.col("pos") * 3 / n)).drop("pos"), f"{path}/in", "part", 3)
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    side = lambda kind, name: _stream(spark, f"{path}/in", schema).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(f"{name}_at"))
    both = state.interval_joined(side("view", "view_id"), side("error", "error_id"), "user_id", "view_id_at", "error_id_at", "2 hours", "1 hour")
    ingest.run_to_end(state.append_batches(both.select("view_id", "error_id"), f"{path}/out", f"{path}/checkpoint", "append"))
    return spark.read.parquet(f"{path}/out").select("view_id", "error_id")


@query("paged_stream", "select page_id, url, length(html) as votes from pages")
def paged_stream(spark: SparkSession, d: str) -> DataFrame:
    """A directory whose pages come in two loads, read as a stream that goes on after a restart where it stopped."""
    directory.register(spark)
    path = fresh(spark, "directory")
    rows = positions(table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("votes")), [F.col("page_id")])
    half = rows.agg(F.floor(F.count("*") / 100)).scalar() * 50
    for part in (rows.where(F.col("pos") < half), rows.where(F.col("pos") >= half)):
        directory.store_pages(part, "pos", f"{path}/in", 50)
        read = spark.readStream.format("paged").schema("page_id long, url string, votes long").option("fetch", "quillspan.sources.directory:stored_page").option("count", "quillspan.sources.directory:stored_pages")
        stream = read.option("root", f"{path}/in").load()
        ingest.run_to_end(state.append_batches(stream, f"{path}/out", f"{path}/checkpoint", "append"))
    return spark.read.parquet(f"{path}/out").select("page_id", "url", "votes")


def unsteady_upload(row: dict, attempt: int) -> None:
    """A stand-in for a store: every seventh file fails always, and of the others every fifth at the first attempt."""
    if row["doc_id"] % 7 == 0 or row["doc_id"] % 5 == 0 and attempt == 1:
        raise OSError(f"no answer for {row['doc_id']}")


@query("delivery_status", """
select cast(doc_id as varchar) as file_id, case when doc_id % 7 = 0 then 'failed' else 'uploaded' end as status, case when doc_id % 7 = 0 then 3 when doc_id % 5 = 0 then 2 else 1 end as attempts,
  case when doc_id % 7 = 0 then 'no answer for ' || doc_id end as error from documents""")
def delivery_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of each file, failures included."""
    path = fresh(spark, "delivery")
    delivery.deliver(table(spark, d, "documents").select("doc_id", "text"), "quillspan.plans.streams:unsteady_upload", path, 3, 0.001)
    return delivery.statuses(spark, path)


@query("delivery_retries", "select doc_id from documents where doc_id % 7 = 0 or doc_id % 3 = 0")
def delivery_retries(spark: SparkSession, d: str) -> DataFrame:
    """Files to be delivered next: those that failed, and those not tried yet."""
    path = fresh(spark, "delivery")
    docs = table(spark, d, "documents").select("doc_id", "text")
    delivery.deliver(docs.where("doc_id % 3 <> 0"), "quillspan.plans.streams:unsteady_upload", path, 2, 0.001)
    return delivery.retries(docs, "doc_id", delivery.statuses(spark, path)).select("doc_id")


@query("swapped_package", "select source, count(*) as n, sum(n_chars) as chars, (select count(*) from documents) as told from documents group by 1")
def swapped_package(spark: SparkSession, d: str) -> DataFrame:
    """A package put in place of an older one in one step, beside what a write that broke off has left."""
    path = fresh(spark, "swapped")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    summary = lambda df: sinks.package_summary(df, "source", "lang", F.col("n_chars"), F.encode("source", "UTF-8"))
    some = docs.where("doc_id % 2 = 0")
    sinks.swap_package(some, path, 300, "doc_id", summary(some))
    folder = sinks.swap_package(docs, path, 300, "doc_id", summary(docs))
    docs.limit(3).write.parquet(f"{path}/snapshot-broken/data")  # a stand-in for a broken write, of any size
    if versions.folders(spark, path) != [folder]:
        raise ValueError("a broken write took the place of a package")
    told = spark.read.schema("rows bigint").json(f"{folder}/summary.json").agg(F.max("rows")).scalar()
    return spark.read.parquet(f"{folder}/data").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).withColumn("told", told)
