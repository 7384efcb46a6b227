"""Readers, sinks and streams: tables are written into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import intake as I
from quillspan.operators import labels as L
from quillspan.operators import rank as R
from quillspan.operators.rank import positions
from quillspan.plans.registry import query, table
from quillspan.scratch import fresh
from quillspan.sources import cards, directory, readers, schemas, sinks, versions
from quillspan.streaming import ingest


@query("catalog_scan", "select 's' || page_id as id, case page_id % 3 when 0 then 'ok' else 'refused' end as rights_status, cast(case when page_id % 2 = 0 then 44100 end as int) as rate from pages where page_id % 3 = 0 and page_id % 2 = 0")
def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sources written as JSON arrays, read with their schema, chosen by rights and id."""
    k = F.col("page_id")
    path = fresh(spark, "catalog")
    rows = table(spark, d, "pages").select(F.concat(F.lit("s"), k).alias("id"), F.when(k % 3 == 0, "ok").otherwise("refused").alias("rights_status"), F.struct(F.when(k % 2 == 0, 44100).alias("sample_rate_hz")).alias("probe"), (k % 4).alias("file"))
    rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct("id", "rights_status", "probe"))).alias("value")).repartition("file").write.partitionBy("file").text(path)
    ids = rows.where("cast(substr(id, 2) as int) % 2 = 0")
    return readers.choose_sources(readers.catalog(spark, path), ids, ["ok"]).select("id", "rights_status", F.col("probe.sample_rate_hz").alias("rate"))


def _manifests(spark: SparkSession, d: str) -> str:
    """A manifest for each page below source/date/stem; every fifth is not valid, every seventh has no duration of its own."""
    k = F.col("page_id")
    body = F.struct(
        F.struct(F.when(k % 2 == 0, F.concat(F.lit("src"), k % 6)).alias("id"), F.lit("n").alias("name")).alias("source"),
        F.struct(F.when(k % 3 != 0, "2024-05-02T00:00:00Z").alias("started_at"), F.lit(60).alias("duration_requested_seconds")).alias("capture"),
        F.struct((k % 5 != 0).alias("valid"), F.struct(F.struct(F.when(k % 7 != 0, (k % 90 + 0.5).cast("string")).alias("duration")).alias("format")).alias("output_probe")).alias("quality"),
    )
    path = fresh(spark, "manifests")
    rows = table(spark, d, "pages").select(F.format_string("s=src%d/t=2024-05-01/stem=st%d/manifest.txt", k % 6, k).alias("path"), F.to_json(body).alias("content"))
    sinks.named_files(rows, path)
    return path


@query("manifest_scan", """
select case when page_id % 2 = 0 then 'src' || page_id % 6 else 's=src' || page_id % 6 end as source_id, 'stem=st' || page_id as stem, case when page_id % 3 <> 0 then '2024-05-02' else 't=2024-05-01' end as date, case when page_id % 7 <> 0 then page_id % 90 + 0.5 else 60.0 end::double as duration_seconds from pages where page_id % 5 <> 0""")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Valid manifests; what one leaves out comes from its path (here of folders named s=, t= and stem=)."""
    root = _manifests(spark, d)
    text = readers.manifests(spark, root, pattern="*.txt")
    return text.select("source_id", "stem", "date", "duration_seconds")


@query("manifest_paths", "select count(*) as files, count(distinct page_id % 6) as sources, true as has_bytes from pages")
def manifest_paths(spark: SparkSession, d: str) -> DataFrame:
    root = _manifests(spark, d)
    files = readers.small_files(spark, root)
    paths = readers.manifest_paths(spark, root, "*.txt", files)
    both = readers.folder_bytes(spark, root, files)
    return paths.agg(F.count("*").alias("files"), F.count_distinct(F.regexp_extract("path", "/s=([^/]*)/", 1)).alias("sources")).withColumn("has_bytes", both.agg(F.max(F.col("bytes") > 0)).scalar())


@query("segment_scan", "select 'g' || doc_id as segment_id, source as source_id, n_chars::double as duration_seconds from documents where doc_id % 3 <> 0 order by source, doc_id")
def segment_scan(spark: SparkSession, d: str) -> DataFrame:
    """Processed records and failures written by key; the good ones read back in order."""
    k = F.col("doc_id")
    records, failures = fresh(spark, "records"), fresh(spark, "failures")
    rows = table(spark, d, "documents").select(F.concat(F.lit("g"), k).alias("segment_id"), F.col("source").alias("source_id"), F.lpad(k.cast("string"), 12, "0").alias("started_at"), F.col("n_chars").cast("double").alias("duration_seconds"), F.when(k % 3 == 0, "no audio").alias("why"))
    good, bad = sinks.with_dead_letters(rows, F.col("why"))
    sinks.json_by_key(good.drop("why").withColumn("status", F.lit("ok")).withColumn("source", F.col("source_id")), records, "source")
    sinks.json_by_key(bad.withColumn("source", F.col("source_id")), failures, "source")
    return readers.segment_records(spark, records, multi_line=False).select("segment_id", "source_id", "duration_seconds")


@query("csv_scan", "select doc_id, source, lang, case when doc_id % 3 = 0 then 0 else n_chars end as n_chars from documents")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "csv")
    rows = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(',"x"\n')).alias("source"), "lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("n_chars").cast("string")).alias("n_chars"))
    sinks.csv_metadata(rows, path)
    back = readers.csv(spark, path, "doc_id bigint, source string, lang string, n_chars bigint")
    return back.withColumn("source", F.regexp_replace("source", ',"x"\n$', ""))


@query("jsonl_log_scan", "select user_id::varchar as key, max(event_id) as seq, arg_max(value, event_id) as value from events group by 1")
def jsonl_log_scan(spark: SparkSession, d: str) -> DataFrame:
    """An append log written in two runs; of each key the last line counts."""
    path = fresh(spark, "log")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "value")
    sinks.append_log(rows.where("seq % 2 = 0"), path)
    sinks.append_log(rows.where("seq % 2 = 1"), path)
    return readers.jsonl_log(spark, path, "key string, seq bigint, value double", "key")


@query("checkpoint_scan", "select 'u' || page_id as uuid, 'f' || page_id as filepath, page_id % 9 + 0.5::double as duration_actual from pages where page_id % 3 = 0")
def checkpoint_scan(spark: SparkSession, d: str) -> DataFrame:
    """A run's state and results as one checkpoint document, read back as its completed recordings."""
    k = F.col("page_id")
    pages = table(spark, d, "pages").select("page_id")
    events = pages.select(F.concat(F.lit("u"), k).alias("uuid"), F.when(k % 3 == 0, "completed").when(k % 3 == 1, "failed").otherwise("started").alias("kind"), k.alias("seq"))
    results = pages.where("page_id % 3 = 0").select(F.concat(F.lit("u"), k).alias("uuid"), F.concat(F.lit("f"), k).alias("filepath"), (k % 9 + 0.5).cast("double").alias("duration_actual"))
    path = fresh(spark, "checkpoint")
    sinks.write_checkpoint(L.checkpoint_state(events, 3), results, path, "2024-05-01T00:00:00Z")
    return readers.checkpoint(spark, path).select("uuid", "filepath", "duration_actual")


@query("numbered_shards", """
with r as (select doc_id, (row_number() over (order by doc_id) - 1) // 100 as s, (count(*) over () + 99) // 100 as n from documents) select printf('train-%05d-of-%05d', s, n) as name, count(*) as rows, min(doc_id) as first, max(doc_id) as last from r group by 1""")
def numbered_shards(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "shards")
    sinks.numbered_shards(table(spark, d, "documents").select("doc_id", "lang"), path, 100, "doc_id")
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("unit_shards", "with r as (select conv_id, turn, (row_number() over (order by conv_id, turn) - 1) // 50 as shard from conversations where conv_id in (select distinct conv_id from conversations order by 1 limit 30)) select shard, count(*) as rows, min(conv_id) as first from r group by 1")
def unit_shards(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "units")
    units = table(spark, d, "conversations").select("conv_id", "turn", F.format_string("%012d/%06d", "conv_id", "turn").alias("iu_id"))
    sinks.unit_shards(units, path, 50, "iu_id", 30, "conv_id")  # the limit on segments is the feature
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("rows"), F.min("conv_id").alias("first"))


@query("label_splits", "select lang as split, count(*) as rows from documents where lang <> 'en' group by 1")
def label_splits(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "splits")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    dry = sinks.label_splits(docs, path, "lang", ("en",), dry_run=True)
    done = sinks.label_splits(docs, path, "lang", ("en",))
    return done.join(dry, ["split", "rows"])


@query("split_card", "select '# Splits' || chr(10) || string_agg(printf('- `%s`: %d rows, %.3f audio hours', lang, n, h), chr(10) order by lang) as card from (select lang, count(*) as n, sum(n_chars)::double / 3600 as h from documents group by 1)")
def split_card(spark: SparkSession, d: str) -> DataFrame:
    splits = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("rows"), (F.sum("n_chars") / 3600).alias("hours"))
    return sinks.split_card(splits, "Splits", "lang")


@query("package_files", "select count(*) as rows, count(distinct source) as sources, (select count(*) from documents) as summary_rows from documents")
def package_files(spark: SparkSession, d: str) -> DataFrame:
    """A package: shards and a summary beside them, resolved through its data folder."""
    path = fresh(spark, "package")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    sinks.write_package(docs, path, 200, "doc_id", sinks.package_summary(docs, "source", "lang", F.col("n_chars"), F.encode("text", "UTF-8")))
    summary = spark.read.schema("rows bigint").json(f"{path}/summary.json")
    back = readers.parquet(spark, path, ["doc_id", "source"])
    return back.agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources")).withColumn("summary_rows", summary.agg(F.max("rows")).scalar())


@query("csv_dataset", "select count(*) as rows, count(distinct lang) as languages, round(sum(n_chars)::double / 3600, 6) as hours from documents")
def csv_dataset(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "dataset")
    sinks.csv_dataset(table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("country"), F.col("n_chars").cast("double").alias("duration_seconds")), path)
    info = spark.read.schema("num_rows bigint, languages_covered array<string>, total_hours_audio double").json(f"{path}/dataset_info.json")
    return info.select(F.col("num_rows").alias("rows"), F.size("languages_covered").cast("long").alias("languages"), F.round("total_hours_audio", 6).alias("hours"))


@query("parquet_footer", "select count(*) as n_rows, 2 as n_columns, count(*) filter (where lang in ('de', 'fr')) as chosen from documents")
def parquet_footer(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "footer")
    table(spark, d, "documents").select("doc_id", "lang").write.parquet(path)
    chosen = readers.parquet_where(spark, path, "lang", ["de", "fr"], ["doc_id"])
    return readers.parquet_rows(spark, path).select("n_rows", F.size("columns").alias("n_columns")).withColumn("chosen", chosen.agg(F.count("*")).scalar())


@query("tokenized_scan", "select doc_id, case doc_id % 2 when 0 then '<|joy|>' else '<|fear|>' end as emotion from documents where doc_id % 3 <> 0")
def tokenized_scan(spark: SparkSession, d: str) -> DataFrame:
    paths = [fresh(spark, "tokenized") for _ in range(2)]
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.when(k % 3 == 0, "").when(k % 2 == 0, "<|joy|> ").otherwise("<|fear|> "), "text").alias("text"))
    for i, p in enumerate(paths):
        rows.where(k % 2 == i).write.parquet(p)
    return readers.tokenized_parquet(spark, *paths).select("doc_id", "emotion")


@query("chained_splits", "select 'train' as split, count(*) as n from documents where doc_id % 5 > 0 union all select 'test', count(*) from documents where doc_id % 5 = 0")
def chained_splits(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.sources import rows

    docs = table(spark, d, "documents").select("doc_id", "lang")
    splits = {"train": docs.where("doc_id % 5 > 0"), "test": docs.where("doc_id % 5 = 0").drop("lang")}
    return rows.chain_splits(splits).groupBy("split").agg(F.count("*").alias("n"))


@query("media_walk", "select count(*) as files, true as all_flac from pages where page_id % 2 = 0")
def media_walk(spark: SparkSession, d: str) -> DataFrame:
    """A file for each page, a thousand to a folder; those of one kind are found by extension among the others."""
    path = fresh(spark, "media")
    k = F.col("page_id")
    name = F.format_string("shelf%d/%d-%s", F.floor(k / 1000), k, F.when(k % 2 == 0, "a.flac").otherwise("b.mp3"))
    sinks.named_files(table(spark, d, "pages").select(name.alias("path"), F.lit("x").alias("content")), path)
    chosen = readers.media_files(spark, path, ["flac"])
    return chosen.agg(F.count("*").alias("files"), F.min(F.col("path").endswith(".flac")).alias("all_flac"))


@query("paged_directory", "select page_id, url from pages order by page_id limit 125")
def paged_directory(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a paged service, made from the pages."""
    directory.register(spark)
    path = fresh(spark, "paged")
    directory.store_pages(positions(table(spark, d, "pages").select("page_id", "url"), [F.col("page_id")]), "pos", path, 50)
    read = spark.read.format("paged").schema("page_id long, url string").option("fetch", "quillspan.sources.directory:stored_page").option("root", path)
    return read.option("limit", "125").option("page_rows", "50").load()


@query("streamed_shards", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def streamed_shards(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed from their files into one shard for each micro-batch, to the end of the input."""
    path = fresh(spark, "stream")
    ingest.run_to_end(ingest.write_shards(_event_stream(spark, d), f"{path}/out", f"{path}/checkpoint", 1000))
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, three files to a batch."""
    path = fresh(spark, "events")
    table(spark, d, "events").repartition(7).write.parquet(path)
    return ingest.file_stream(spark, path, schemas.EVENT, 3)


@query("streamed_upserts", "select user_id, arg_max(value, event_id) as value from events group by 1")
def streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Last values by user, from changes that are brought together after every second batch."""
    path = fresh(spark, "upserts")
    stream = _event_stream(spark, d).select("user_id", "event_id", "value")
    ingest.run_to_end(versions.upsert_stream(stream, ["user_id"], "event_id", f"{path}/out", f"{path}/checkpoint", 2))
    return versions.read(spark, f"{path}/out", ["user_id"], "event_id").select("user_id", "value")


@query("streamed_packages", "select count(*) as records, true as packaged from events")
def streamed_packages(spark: SparkSession, d: str) -> DataFrame:
    """Records appended batch by batch, all of them packaged after every second batch."""
    path = fresh(spark, "packages")
    ingest.run_to_end(ingest.package_every(_event_stream(spark, d), f"{path}/records", f"{path}/checkpoint", 2, lambda all_rows, i: sinks.sharded_parquet(all_rows, f"{path}/package", 500)))
    packaged = spark.read.parquet(f"{path}/package").agg(F.count("*") > 0).scalar()
    return spark.read.parquet(f"{path}/records").agg(F.count("*").alias("records")).withColumn("packaged", packaged)


@query("resumed_work", "select doc_id, length(text) as chars from documents")
def resumed_work(spark: SparkSession, d: str) -> DataFrame:
    """Work done in two runs; the second takes up only what the first left."""
    path = fresh(spark, "resumed")
    docs = table(spark, d, "documents").select("doc_id", "text")
    work = lambda df: df.select("doc_id", F.length("text").cast("long").alias("chars"))
    sink = lambda df: sinks.append_log(df, path)
    back = lambda: spark.read.schema("doc_id bigint, chars bigint").json(path)
    ingest.process_pending(docs.where("doc_id % 3 = 0"), I.point_lookup(docs, "doc_id", -1), "doc_id", work, sink)
    ingest.process_pending(docs, back(), "doc_id", work, sink)
    return back()


@query("upload_retries", "select event_id from events where event_type <> 'purchase' order by ts, event_id limit 15")
def upload_retries(spark: SparkSession, d: str) -> DataFrame:
    ok = F.struct((F.col("event_type") == "purchase").alias("ok"))
    rows = table(spark, d, "events").select("event_id", F.struct(F.col("ts").cast("string").alias("started_at")).alias("capture"), F.struct(F.format_string("%012d", "event_id").alias("metadata_path")).alias("local"), F.struct(ok.alias("audio_upload"), ok.alias("metadata_upload")).alias("gcs"))
    return ingest.retry_selection(rows, 15).select("event_id")


@query("latest_annotations", """
with r as (select 'i' || user_id as iu_id, case event_id % 5 when 0 then 'codex-x' else 'ann' || event_id % 3 end as annotator, event_type as emotion, case when event_id % 11 = 0 then null else ts end as stamp, event_id as seq from events where user_id % 10 <> 0)
select iu_id, annotator, emotion from r where not starts_with(annotator, 'codex-') qualify row_number() over (partition by iu_id order by stamp desc nulls last, seq desc) = 1""")
def latest_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The last annotation of each item by people; stamps that cannot be read come first."""
    k = F.col("event_id")
    log = table(spark, d, "events").select(
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("i"), "user_id")).otherwise("").alias("iu_id"), F.when(k % 5 == 0, "codex-x").otherwise(F.concat(F.lit("ann"), k % 3)).alias("annotator"),
        F.col("event_type").alias("emotion"), F.when(k % 11 == 0, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("updated_at"), k.alias("seq"),
    )
    return L.latest_annotations(log).select("iu_id", "annotator", "emotion")


@query("payload_scan", "select doc_id, case doc_id % 3 when 0 then md5(text) when 1 then 'absent' else md5('') end as payload_md5 from documents")
def payload_scan(spark: SparkSession, d: str) -> DataFrame:
    """A row's payload: its own bytes, else what the file at its path holds, else none."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    files = docs.where(k % 3 == 2).select(F.concat(F.lit("f"), k).alias("path"), F.encode(F.lit(""), "UTF-8").alias("content"))
    audio = F.struct(F.when(k % 3 == 0, F.encode("text", "UTF-8")).alias("bytes"), F.concat(F.lit("f"), k).alias("path"))
    return readers.with_payload(docs.select("doc_id", audio.alias("audio")), files).select("doc_id", F.coalesce(F.md5("payload"), F.lit("absent")).alias("payload_md5"))


_CARD = {"language": ["en", "de"], "license": "other"}


@query("sampled_card", r"""
with r as (select source, doc_id, n_chars, strlen(text) as b, row_number() over (partition by source order by md5('7|' || doc_id), doc_id) as rn from documents),
p as (select * from r where rn <= 5), g as (select source, count(*) as n, count(*) filter (where rn <= 5) as s from r group by 1)
select '---' || chr(10) || 'language:' || chr(10) || '  - en' || chr(10) || '  - de' || chr(10) || 'license: other' || chr(10) || '---' || chr(10) || chr(10) || '# Sample' || chr(10) || chr(10) || 'Five documents of each source.' || chr(10) || chr(10) ||
  '## Contents' || chr(10) || chr(10) || (select '- Rows: ' || count(*) || chr(10) || '- Rows wanted of each group: 5' || chr(10) || printf('- Hours: %.3f', sum(n_chars)::double / 3600) || chr(10) || printf('- Payload: %.1f MB', sum(b)::double / 1000000) || chr(10) || '- Seed: 7' from p) || chr(10) || chr(10) ||
  '## Groups' || chr(10) || chr(10) || (select string_agg(printf('- `%s`: %d selected / %d available', source, s, n), chr(10) order by source) from g) || chr(10) || chr(10) || '## Columns' || chr(10) || chr(10) ||
  '- `doc_id`: bigint' || chr(10) || '- `source`: string' || chr(10) || '- `n_chars`: bigint' || chr(10) || '- `text`: string' as card""")
def sampled_card(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"), "text")
    picked = R.sample_per_group(docs, ["source"], "doc_id", 5, 7)
    return cards.sample_card("Sample", _CARD, "Five documents of each source.", picked, docs, "source", F.col("n_chars"), F.octet_length("text"), 5, 7)


@query("unit_card", r"""
select '---' || chr(10) || 'language:' || chr(10) || '  - en' || chr(10) || '  - de' || chr(10) || 'license: other' || chr(10) || '---' || chr(10) || chr(10) || '# Units' || chr(10) || chr(10) || 'Turns by role.' || chr(10) || chr(10) ||
  '## Contents' || chr(10) || chr(10) || (select '- Rows: ' || count(*) || chr(10) || '- Labels: ' || count(distinct role) || chr(10) || printf('- Hours: %.3f', sum(length(text)) / 15.0::double / 3600) from conversations) || chr(10) || chr(10) ||
  '## Labels' || chr(10) || chr(10) || (select string_agg(printf('- `%s`: %d rows, %.3f hours', role, n, s / 15.0::double / 3600), chr(10) order by role) from (select role, count(*) as n, sum(length(text)) as s from conversations group by 1)) || chr(10) || chr(10) ||
  '## Columns' || chr(10) || chr(10) || '- `role`: string' || chr(10) || '- `text`: string' as card""")
def unit_card(spark: SparkSession, d: str) -> DataFrame:
    return cards.unit_card("Units", _CARD, "Turns by role.", table(spark, d, "conversations").select("role", "text"), "role", F.length("text") / 15.0)
