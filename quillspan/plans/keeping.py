"""Counted writes, positional and order-keeping joins, plans of cuts, spot checks, the table store, and streams with a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import dates
from quillspan.operators import metrics as M
from quillspan.operators import rank as R
from quillspan.operators import reports as P
from quillspan.operators import signal as G
from quillspan.operators.intake import migrated_annotations
from quillspan.plans.ordered import _PRED, prf_summary
from quillspan.plans.registry import query, table
from quillspan.plans.relational import token_rows, token_set_rules
from quillspan.plans.scalars import turn_pairs
from quillspan.plans.streams import in_files
from quillspan.scratch import fresh
from quillspan.sources import readers, sinks
from quillspan.sources.store import Store, Table
from quillspan.streaming import ingest

_REASONS = ("unlabeled", "low_quality", "unknown_emotion", "duration_gte_limit", "empty_text", "missing_audio")


@query("written_counts", f"""
with r as (select case when l.doc_id is null then 'unlabeled' when l.quality = 0 then 'low_quality' when l.toxic = 1 then 'unknown_emotion' when n_chars / 200.0 >= 20 then 'duration_gte_limit' when trim(text) = '' then 'empty_text' else 'kept' end as reason
  from documents d left join labels l using (doc_id))
select v.reason, count(r.reason) as n, (select count(*) from r where reason = 'kept') as written from (select unnest({[*_REASONS, 'kept']}) as reason) v left join r using (reason) group by 1""")
def written_counts(spark: SparkSession, d: str) -> DataFrame:
    """Accepted rows written, and all rows counted by what dropped them, in one pass."""
    path = fresh(spark, "counted")
    counts = sinks.write_counted(token_rows(spark, d), token_set_rules(), path, _REASONS)
    rows = spark.createDataFrame(list(counts.items()), "reason string, n long")
    return rows.withColumn("written", spark.read.parquet(path).agg(F.count("*")).scalar())


@query("zipped_tables", """
select coalesce(d.pos, p.pos) as pos, doc_id, page_id from (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) d full join (select page_id, row_number() over (order by page_id) - 1 as pos from pages) p on p.pos = d.pos""")
def zipped_tables(spark: SparkSession, d: str) -> DataFrame:
    return R.zipped(table(spark, d, "documents").select("doc_id"), table(spark, d, "pages").select("page_id"), [F.col("doc_id")], [F.col("page_id")])


@query("restored_order", "select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) as place from documents qualify place <= 100")
def restored_order(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of the longest documents, in the order in which they were chosen."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    best = docs.orderBy(F.desc("n_chars"), "doc_id").limit(100)  # the report's size is the feature
    chosen = R.positions(best, [F.desc("n_chars"), F.col("doc_id")], "place").select("doc_id", (F.col("place") + 1).alias("place"))
    return R.restored(docs, chosen, "doc_id", "place")


@query("values_by_count", "select source, count(*) as n, row_number() over (order by count(*) desc, source) - 1 as place from documents group by 1")
def values_by_count(spark: SparkSession, d: str) -> DataFrame:
    return R.by_count(table(spark, d, "documents"), "source")


@query("cut_plan", """
select doc_id, k as chunk, k * 30.0::double as start_seconds, least(n_chars / 10.0::double, (k + 1) * 30.0) as end_seconds from (select doc_id, n_chars, unnest(range(cast(ceil(n_chars / 10.0 / 30) as bigint))) as k from documents where n_chars > 0)""")
def cut_plan(spark: SparkSession, d: str) -> DataFrame:
    return G.cut_plan(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 10.0).alias("seconds")), ["doc_id"], "seconds", 30.0)


@query("spot_check")
def spot_check(spark: SparkSession, d: str) -> DataFrame:
    """Turns and the turns after them, five of each role."""
    pairs = turn_pairs(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return P.spot_check(pairs.withColumn("key", F.concat_ws("/", "conv_id", "turn")), "key", "role", "ref", "pred", 5, 917)


_TABLES = {
    "samples": Table("doc_id long, text string, seq long", ("doc_id",), "seq"),
    "annotations": Table("doc_id long, annotator string, emotion string, low_quality int, seq long", ("doc_id", "annotator"), "seq", "samples", "doc_id"),
    "seen": Table("user_key string, doc_id long, seen_count int, seq long", ("user_key", "doc_id"), "seq", "samples", "doc_id"),
}


def _store(spark: SparkSession, d: str, tag: str) -> Store:
    """Samples and what refers to them, from documents and labels."""
    store = Store(spark, fresh(spark, tag), _TABLES)
    store.create()
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    store.upsert("samples", docs.select("doc_id", "text", F.col("doc_id").alias("seq")))
    store.upsert("annotations", labels.select("doc_id", F.when(F.col("toxic") == 1, "eve").otherwise("ann").alias("annotator"), F.when(F.col("quality") == 1, "joy").otherwise("fear").alias("emotion"), F.lit(0).alias("low_quality"), F.lit(1).cast("long").alias("seq")))
    store.upsert("seen", labels.select(F.lit("u").alias("user_key"), "doc_id", F.lit(1).alias("seen_count"), F.lit(1).cast("long").alias("seq")))
    return store


@query("store_cascade", """
select 'samples' as name, count(*) as n, sum(doc_id) as keys from documents where doc_id % 5 <> 0 union all
select unnest(['annotations', 'seen']), count(*), sum(doc_id) from labels where doc_id % 5 <> 0""")
def store_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Samples deleted with the annotations of them and with who has seen them."""
    store = _store(spark, d, "cascade")
    store.delete("samples", table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id"))
    each = [store.rows(n).agg(F.count("*").alias("n"), F.sum("doc_id").alias("keys")).select(F.lit(n).alias("name"), "n", "keys") for n in _TABLES]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("store_cleared", "select 0::bigint as annotations, 0::bigint as seen, count(*) as samples from documents")
def store_cleared(spark: SparkSession, d: str) -> DataFrame:
    """All rows deleted by force, and the samples imported again."""
    store = _store(spark, d, "cleared")
    store.clear("samples")
    store.upsert("samples", table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("seq")))
    n = lambda name: store.rows(name).agg(F.count("*")).scalar()
    return spark.range(1).select(n("annotations").alias("annotations"), n("seen").alias("seen"), n("samples").alias("samples"))


@query("store_migrated", "select doc_id, case when doc_id % 3 = 0 then 'low_quality' else 'joy' end as emotion, 0 as low_quality, cast(null as varchar) as notes from labels")
def store_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of an older layout get the columns they lack, and their flags become labels; a second start changes nothing."""
    path = fresh(spark, "migrated")
    older = Store(spark, path, {"annotations": Table("doc_id long, emotion string, low_quality int, seq long", ("doc_id",), "seq")})
    older.create()
    older.upsert("annotations", table(spark, d, "labels").select("doc_id", F.lit("joy").alias("emotion"), (F.col("doc_id") % 3 == 0).cast("int").alias("low_quality"), F.lit(1).cast("long").alias("seq")))
    newer = Store(spark, path, {"annotations": Table("doc_id long, emotion string, low_quality int, notes string, seq long", ("doc_id",), "seq")})
    changed = [newer.migrate(backfill={"annotations": migrated_annotations}) for _ in range(2)]
    if changed != [["annotations"], []]:
        raise ValueError("a migrated table was migrated again")
    return newer.rows("annotations").select("doc_id", "emotion", "low_quality", "notes")


@query("budgeted_stream", "select event_id, case when event_id % 4 < 2 then 1 else 2 end as run from events")
def budgeted_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream in four files with a budget of a row more than the first file has: the second batch is finished, the rest is left for the next run."""
    path = fresh(spark, "budget")
    events = table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("part"))
    in_files(events, f"{path}/in", "part", 4)
    budget = events.where("part = 0").count() + 1

    def start(run: int):
        def begin(took):
            def put(batch: DataFrame, batch_id: int) -> None:
                took(batch.count())
                batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

            stream = ingest.file_stream(spark, f"{path}/in", "event_id long", 1)
            return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

        return begin

    ingest.run_until(start(1), rows=budget)
    ingest.run_until(start(2))
    return spark.read.parquet(f"{path}/out").select("event_id", "run")


@query("first_examples", "select conv_id, turn, length(text) as chars from conversations order by conv_id, turn limit 50")
def first_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty examples of a report, by their key."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.struct("conv_id", "turn").alias("key"))
    return P.first_examples(turns, "key").drop("key")


@query("gated_metrics", f"""
with p as (select label, {_PRED} as p from embeddings) select round(avg((label = p)::int), 6) as accuracy, true as passed, true as stopped from p""")
def gated_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A run's metrics against what is required of them: the gate lets them pass, and stops them where more is asked than they reach."""
    metrics = prf_summary(spark, d).first().asDict()
    M.require(metrics, {"accuracy": 0.05, "macro_f1": 0.01})
    try:
        M.require(metrics, {"accuracy": 1.01})
        stopped = False
    except ValueError:
        stopped = True
    return prf_summary(spark, d).select("accuracy", F.lit(True).alias("passed"), F.lit(stopped).alias("stopped"))


@query("path_stamps", "select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp from events")
def path_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.path_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("first_audio_stream", "select page_id, case when page_id % 3 < 2 then cast(8000 * (1 + page_id % 3) as int) end as rate from pages")
def first_audio_stream(spark: SparkSession, d: str) -> DataFrame:
    """The first audio stream of a probe that also lists a picture; null where there is no audio."""
    k = F.col("page_id")
    stream = lambda kind, rate: F.struct(kind.alias("codec_type"), rate.cast("int").alias("rate"))
    audio = F.when(k % 3 < 2, "audio").otherwise("data")
    probe = F.struct(F.array(stream(F.lit("video"), F.lit(1)), stream(audio, 8000 * (1 + k % 3)), stream(audio, F.lit(5))).alias("streams"))
    return table(spark, d, "pages").select("page_id", probe.alias("probe")).select("page_id", readers.first_audio(F.col("probe"))["rate"].alias("rate"))
