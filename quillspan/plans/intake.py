"""Choosing stations, segments and rows, and rows built from them, on stand-ins made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import dates, vocab
from quillspan.functions import numbers as N
from quillspan.functions import text as T
from quillspan.operators import intake as I
from quillspan.operators import labels as L
from quillspan.operators import metrics as M
from quillspan.operators import rank as R
from quillspan.operators import reports as P
from quillspan.operators import rules
from quillspan.operators import sequential
from quillspan.operators import signal as G
from quillspan.plans.registry import query, table
from quillspan.sources import readers, rows, sinks

# Stations stand in pages: the host is the name, the length of the page its votes.
_LANGUAGES = ("English", "engilsh, xx", "DE", "Portuguese Brazil", "", "klingon", "français", "uk", "ua")
_COUNTRIES = ("US", "gb", "AU", "DE")
_TAGS = ("News, talk ,pop", "music,rock", "noticias,,all news", "")
_STATIONS = f"""
(select page_id as pos, 'u' || page_id as stationuuid, regexp_extract(url, '://([^/?#]*)', 1) || case page_id % 3 when 0 then ' Info' else '' end as name, 'http://s/' || page_id % 40 as url_resolved, {list(_COUNTRIES)}[page_id % 4 + 1] as countrycode,
  {list(_LANGUAGES)}[page_id % 9 + 1] as language, {list(_TAGS)}[page_id % 4 + 1] as tags, case when page_id % 11 = 0 then null else length(html) end as votes,
  {['English', 'English', 'German', 'Portuguese Brazil', '', 'Klingon', 'French', 'Uk', 'Ukrainian']}[page_id % 9 + 1] as language_canonical from pages)"""


def _pick(values: tuple[str, ...], by: str, n: int) -> F.Column:
    return F.get(F.lit(list(values)), (F.col(by) % n).cast("int"))


def _stations(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    raw = table(spark, d, "pages").select(
        F.col("page_id").alias("pos"), F.concat(F.lit("u"), "page_id").alias("stationuuid"), F.concat(host, F.when(F.col("page_id") % 3 == 0, " Info").otherwise("")).alias("name"), F.concat(F.lit("http://s/"), F.col("page_id") % 40).alias("url_resolved"),
        _pick(_COUNTRIES, "page_id", 4).alias("countrycode"), _pick(_LANGUAGES, "page_id", 9).alias("language"), _pick(_TAGS, "page_id", 4).alias("tags"), F.when(F.col("page_id") % 11 != 0, F.length("html")).cast("int").alias("votes"),
    )
    return readers.station_rows(raw).join(raw.select("stationuuid", "pos"), "stationuuid")


@query("station_filter", f"""
select stationuuid, countrycode, language_canonical, votes from {_STATIONS} where coalesce(votes, 0) >= 60 and language_canonical in ('English', 'German', 'Ukrainian') and upper(countrycode) in ('US', 'GB', 'DE') order by coalesce(votes, 0) desc, pos limit 40""")
def station_filter(spark: SparkSession, d: str) -> DataFrame:
    return I.filter_stations(_stations(spark, d), 60, ["en", "Deutsch", "ukranian"], ["us", "GB", "de"], 40).select("stationuuid", "countrycode", "language_canonical", "votes")


_SCORE = "case pos % 4 when 0 then -1 when 1 then -6 when 2 then 2 else 0 end + case when pos % 3 = 0 then 2 else 0 end"


@query("news_stations", f"""
with s as (select *, {_SCORE} as score, case language_canonical when 'Portuguese Brazil' then 'Portuguese' else language_canonical end as lang from {_STATIONS}),
r as (select *, row_number() over (partition by lang order by score desc, coalesce(votes, 0) desc, pos) as rn from s where trim(language) <> '' and score >= 1)
select lang as language_canonical, stationuuid, score, votes from r where rn = 1""")
def news_stations(spark: SparkSession, d: str) -> DataFrame:
    return I.news_stations(_stations(spark, d).drop("language_canonical")).select("language_canonical", "stationuuid", F.col("score").cast("int").alias("score"), "votes")


@query("station_listing", f"""
select name || ' | ' || language_canonical || ' | votes=' || coalesce(votes, 0) as line from (select * from {_STATIONS} order by coalesce(votes, 0) desc, pos limit 20)
union all select '... and ' || (count(*) - 20) || ' more' from pages having count(*) > 20""")
def station_listing(spark: SparkSession, d: str) -> DataFrame:
    stations = _stations(spark, d)
    votes = F.coalesce("votes", F.lit(0))
    return I.listing(stations, [votes.desc(), F.col("pos")], F.concat_ws(" | ", "name", "language_canonical", F.concat(F.lit("votes="), votes)))


@query("sampled_stations", """
select 'without' as kind, page_id, null::bigint as draw from (select page_id from pages order by md5('5|' || page_id), page_id limit 10)
union all select 'with', p.page_id, i from (select unnest(range(2 * (select count(*) from pages))) as i) d
  join (select page_id, row_number() over (order by md5('5|' || page_id), page_id) - 1 as pos from pages) p on p.pos = cast(('0x' || substr(md5('5|draw|' || i), 1, 8)) as bigint) % (select count(*) from pages)""")
def sampled_stations(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id")
    without = R.sample_rows(pages, "page_id", 10, 5).select(F.lit("without").alias("kind"), "page_id", F.lit(None).cast("long").alias("draw"))
    return without.unionByName(R.sample_rows(pages, "page_id", 2 * pages.count(), 5, replace=True).select(F.lit("with").alias("kind"), "page_id", "draw"))


# Recordings of these stations.
_RESULTS = f"""
(select *, page_id % 5 <> 0 as success, case when page_id % 7 = 0 then '' when page_id % 2 = 0 then '/data/in/' || page_id || '.flac' else 'rel/' || page_id || '.flac' end as filepath, page_id % 97 + 0.25 as duration_actual, page_id * 10 as file_size_bytes,
  case page_id % 3 when 0 then '' when 1 then '2024-05-0' || page_id % 9 + 1 || 'T10:00:00Z' else 'bad' end as completed_at, case page_id % 4 when 0 then '' else '2024-04-30T23:59:59+02:00' end as started_at from (select pos as page_id, * from {_STATIONS}))"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    s = _stations(spark, d)
    k = F.col("pos")
    station = F.struct("stationuuid", "name", "url_resolved", F.lit("land").alias("country"), "countrycode", "language", "language_canonical", "tags", F.lit("mp3").alias("codec"), F.lit(128).alias("bitrate"), "votes", F.lit("http://h").alias("homepage"))
    return s.select(
        k.alias("page_id"), station.alias("station"), (k % 5 != 0).alias("success"), F.when(k % 7 == 0, "").when(k % 2 == 0, F.concat(F.lit("/data/in/"), k, F.lit(".flac"))).otherwise(F.concat(F.lit("rel/"), k, F.lit(".flac"))).alias("filepath"),
        (k % 97 + 0.25).alias("duration_actual"), (k * 10).alias("file_size_bytes"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("2024-05-0"), k % 9 + 1, F.lit("T10:00:00Z"))).otherwise("bad").alias("completed_at"),
        F.when(k % 4 == 0, "").otherwise("2024-04-30T23:59:59+02:00").alias("started_at"), F.lit(0.5).alias("silence_ratio"), F.lit(0.25).alias("peak_amplitude"),
    )


@query("metadata_rows", f"""
select case when filepath like '/data/%' then substr(filepath, 7) else filepath end as audio, name as station_name, stationuuid as station_uuid, countrycode as country_code, language_canonical as language, language as language_raw, votes, duration_actual::double as duration_seconds,
  file_size_bytes, case when length(completed_at) >= 10 then left(completed_at, 10) when length(started_at) >= 10 then left(started_at, 10) else '' end as recording_date, 16000 as sample_rate, 1 as channels from {_RESULTS} where success and filepath <> ''""")
def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    out = rows.metadata_rows(_results(spark, d), "/data")
    return out.select("audio", "station_name", "station_uuid", "country_code", "language", "language_raw", "votes", "duration_seconds", "file_size_bytes", "recording_date", "sample_rate", "channels")


@query("shard_rows", f"""
select name as station_name, stationuuid as station_uuid, round_even(duration_actual, 1)::double as duration_seconds, file_size_bytes, left(completed_at, 10) as recording_date, case when filepath <> '' and filepath not like '/%' then '/base/' || filepath else filepath end as path from {_RESULTS}""")
def shard_rows(spark: SparkSession, d: str) -> DataFrame:
    out = rows.shard_rows(_results(spark, d), T.absolute_path(F.col("filepath"), "/base"), F.col("file_size_bytes"))
    return rows.metadata_only(out.withColumn("path", F.col("audio"))).select("station_name", "station_uuid", "duration_seconds", "file_size_bytes", "recording_date", "path")


@query("output_paths", f"""
select stationuuid, 'out/' || countrycode || '/' || language_canonical || '/' || stationuuid || '.flac' as output_path, 'o/audio_16k_flac/' || countrycode || '/2024-05-01/' || stationuuid || '_16k.flac' as stripped,
  'gs://b/raw/source_id=' || countrycode || '/date=2024-05-01/' || stationuuid || '.wav' as uri from {_STATIONS} where language_canonical <> ''""")
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2024-05-01")
    out = rows.output_paths(_stations(spark, d).where("language_canonical <> ''"), "out", ".FLAC")
    return out.select("stationuuid", "output_path", rows.segment_path("stripped", "o", F.col("countrycode"), day, F.col("stationuuid")).alias("stripped"), rows.object_uri("b/", "raw", F.col("countrycode"), day, F.concat(F.lit("/x/"), "stationuuid", F.lit(".wav"))).alias("uri"))


@query("run_stats", f"select count(*) as total, count(*) filter (where success) as completed, count(*) filter (where not success) as failed, cast(sum(file_size_bytes) filter (where success) as bigint) as total_bytes, round(cast(sum(duration_actual) filter (where success) as double), 6) as total_duration, round(cast(sum(file_size_bytes) filter (where success) as double) / cast(sum(duration_actual) filter (where success) as double), 6) as avg_speed from {_RESULTS}")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    out = P.run_stats(_results(spark, d), F.col("success"), F.col("file_size_bytes"), F.col("duration_actual"))
    return out.withColumn("total_duration", F.round("total_duration", 6)).withColumn("avg_speed", F.round("avg_speed", 6))


@query("processing_status", "select count(*) filter (where quality = 1) as processed_ok, round_even(coalesce(cast(sum(n_chars) filter (where quality = 1) as double), 0) / 3600, 3) as hours, count(*) filter (where quality = 0) as failures, (select count(*) from benchmark) as packaged_shards from documents join labels using (doc_id)")
def processing_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return P.processing_status(docs.where("quality = 1"), docs.where("quality = 0"), table(spark, d, "benchmark").select("item_id"), "n_chars")


# Mixture sources of six kinds stand in documents.
_KINDS = ("radio", "transcribed", "acted_file", "spoken_word", "dialogue", "statement")
_EMOTIONS = ("Happy", "bored", "FRUSTRATED", "neutral", "")
_ADAPTED = f"""
(select doc_id, {list(_KINDS)}[doc_id % 6 + 1] as kind, {list(_EMOTIONS)}[doc_id % 5 + 1] as said, case when doc_id % 13 = 0 then '' when doc_id % 6 = 2 then ['That is exactly what happened.', 'It''s eleven o''clock.', ''][doc_id % 3 + 1]
  when doc_id % 6 = 3 then 'Say the word ab cd.' when doc_id % 6 = 5 then {['Kids are talking by the door.', 'Dogs are sitting by the door.', 'other words']}[doc_id % 3 + 1] else trim(regexp_replace(text, '\\s+', ' ', 'g')) end as body,
  case when doc_id % 17 = 0 then null else n_chars / 100.0 end as secs, doc_id % 19 = 0 as bare, doc_id % 6 = 5 and doc_id % 7 = 0 as sung from documents)"""


def _adapted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    blank = lambda c: F.when(k % 13 == 0, "").otherwise(c)
    said = _pick(_EMOTIONS, "doc_id", 5)
    code = F.get(F.lit(["TIE", "IEO", "XXX"]), (k % 3).cast("int"))
    statement = F.get(F.lit(["01", "DOGS are  sitting by the door", "other words"]), (k % 3).cast("int"))
    own = {
        "radio": {"text": blank(F.col("text")), "emotion": said}, "transcribed": {"transcription": blank(F.col("text")), "major_emotion": said},
        "acted_file": {"file": F.concat(F.lit("x/1001_"), blank(code), F.lit("_ANG_XX.wav")), "emotion": said}, "spoken_word": {"path": F.when(k % 13 == 0, "x/ab.wav").otherwise("x/OAF_ab-cd_angry.wav"), "label": said},
        "dialogue": {"Utterance": blank(F.col("text")), "Emotion": said}, "statement": {"statement": blank(statement), "emotion": said, "vocal_channel": F.when(k % 7 == 0, " Song").when(k % 2 == 0, "Speech")},
    }
    out = None
    seconds = F.when(k % 17 != 0, F.col("n_chars") / 100.0)
    for i, (kind, columns) in enumerate(own.items()):
        payload = F.when(k % 19 != 0, F.encode(F.lit("x"), "UTF-8"))
        part = docs.where(k % 6 == i).select("doc_id", payload.alias("_payload"), F.lit("a/b.FLAC" if i % 2 else "a/b").alias("_path"), seconds.cast("string").alias("duration"), *[c.alias(name) for name, c in columns.items()])
        part = rows.adapted(part, kind, kind, "doc_id", F.col("_payload"), F.col("_path"), 0.35, 40.0)
        out = part if out is None else out.unionByName(part)
    return out


_LABEL = "case said when 'Happy' then 'joy' when 'FRUSTRATED' then 'anger' when 'neutral' then 'neutral' when '' then case when kind = 'acted_file' then 'anger' end end"
_WHY = f"case when sung then 'non_speech' when ({_LABEL}) is null then 'unknown_label' when body = '' then 'empty_text' when secs is null or secs < 0.35 or secs >= 40 then 'duration' when bare then 'missing_audio_bytes' end"


@query("source_adapters", f"""
select kind as source, doc_id as source_index, kind || '/' || lpad(doc_id::varchar, 7, '0') || case when doc_id % 2 = 1 then '.FLAC' else '.wav' end as audio_path, md5('<|' || ({_LABEL}) || '|> ' || body) as target_md5, ({_LABEL}) as label from {_ADAPTED} where ({_WHY}) is null""")
def source_adapters(spark: SparkSession, d: str) -> DataFrame:
    kept = _adapted(spark, d).where("skip_reason is null")
    return kept.select("source", "source_index", F.col("audio.path").alias("audio_path"), F.md5("target").alias("target_md5"), "label")


@query("mixture_counts", f"""
select kind as source, case when ({_WHY}) is null then ({_LABEL}) end as label, ({_WHY}) as skip_reason, count(*) as n from {_ADAPTED} group by all""")
def mixture_counts(spark: SparkSession, d: str) -> DataFrame:
    out = _adapted(spark, d)
    return out.groupBy("source", F.when(F.col("skip_reason").isNull(), F.col("label")).alias("label"), "skip_reason").agg(F.count("*").alias("n"))


_TAGGED = "(select doc_id, source, n_chars / 100.0 as secs, case doc_id % 4 when 0 then '<|joy|> ' || text when 1 then text || ' <|fear|>' when 2 then ' <|anger|> ' else text end as t, text, doc_id % 4 as k, doc_id % 23 = 0 as no_audio, doc_id % 29 = 0 as no_bytes from documents)"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = F.when(k % 4 == 0, F.concat(F.lit("<|joy|> "), "text")).when(k % 4 == 1, F.concat("text", F.lit(" <|fear|>"))).when(k % 4 == 2, " <|anger|> ").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") / 100.0).alias("secs"), t.alias("t"), F.when(k % 23 != 0, F.lit("a")).alias("audio"), F.when((k % 23 != 0) & (k % 29 != 0), F.encode(F.lit("x"), "UTF-8")).alias("payload"))


@query("training_rows", f"select doc_id from {_TAGGED} where k in (0, 1) and trim(text) <> '' and secs >= 0.35 and secs < 20")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.training_rows(_tagged(spark, d), "t", F.col("secs"), 0.35, 20.0).select("doc_id")


@query("concat_input", f"""
select case when no_audio then 'missing_audio' when no_bytes then 'missing_audio_payload' when k = 3 then 'missing_emotion_token' when k = 2 or trim(text) = '' then 'empty_body' when secs < 0.35 or secs > 20 then 'iu_duration' else 'kept' end as drop_reason, count(*) as n
from (select * from {_TAGGED} order by doc_id limit 400) group by 1""")
def concat_input(spark: SparkSession, d: str) -> DataFrame:
    asked = rules.concat_rules(F.col("audio"), F.col("payload"), F.col("t"), F.col("secs"), 0.35, 20.0)
    first = _tagged(spark, d).orderBy("doc_id").limit(400)  # the input cap is the feature
    return rules.reason_counts(first, asked)


@query("concat_accepted", f"select doc_id from (select * from {_TAGGED} order by doc_id limit 400) where not no_audio and not no_bytes and k in (0, 1) and trim(text) <> '' and secs between 0.35 and 20")
def concat_accepted(spark: SparkSession, d: str) -> DataFrame:
    asked = rules.concat_rules(F.col("audio"), F.col("payload"), F.col("t"), F.col("secs"), 0.35, 20.0)
    return I.accepted_up_to(_tagged(spark, d), asked, 400, "doc_id").select("doc_id")


@query("label_ids", f"select doc_id, case k when 0 then 2 when 1 then 7 else 5 end as label_id from {_TAGGED} where k < 3")
def label_ids(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).where("doc_id % 4 < 3").select("doc_id", I.label_id(F.col("t"), vocab.TOKENS).alias("label_id"))


@query("concat_rows", r"""
with u as (select conv_id, turn, trim(text) as body, case turn % 2 when 0 then '<|joy|>' else '<|fear|>' end as token, role as source, role || '/' || turn as source_path, length(text) / 20.0 as seconds from conversations),
c as (select conv_id, '{' || string_agg('"' || source || '":' || n, ',' order by source) || '}' as source_counts_json from (select conv_id, source, count(*) as n from u group by all) group by 1),
e as (select conv_id, '{' || string_agg('"' || token || '":' || n, ',' order by token) || '}' as emotion_counts_json from (select conv_id, token, count(*) as n from u group by all) group by 1)
select conv_id, md5(string_agg(body || ' ' || token, ' ' order by turn)) as text_md5, round(sum(seconds) + (count(*) - 1) * 0.08, 6)::double as duration_seconds, count(*) as iu_count, string_agg(source_path, ',' order by turn) as paths, any_value(source_counts_json) as source_counts_json,
  any_value(emotion_counts_json) as emotion_counts_json from u join c using (conv_id) join e using (conv_id) group by 1""")
def concat_rows(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "conversations").select(
        "conv_id", "turn", F.trim("text").alias("body"), F.when(F.col("turn") % 2 == 0, "<|joy|>").otherwise("<|fear|>").alias("token"), F.col("role").alias("source"), F.concat_ws("/", "role", "turn").alias("source_path"), (F.length("text") / 20.0).alias("seconds"),
    )
    out = rows.concat_rows(u, "conv_id", "turn")
    return out.select("conv_id", F.md5("text").alias("text_md5"), F.round("duration_seconds", 6).alias("duration_seconds"), "iu_count", F.array_join("source_paths", ",").alias("paths"), "source_counts_json", "emotion_counts_json")


# Captures and gates.
@query("capture_gates", r"""
with c as (select page_id, page_id % 4 as a, page_id % 5 as b, page_id % 97 + 0.5 as secs from pages)
select page_id, case when a = 0 then 22050 when a = 1 then 8000 when b = 0 then 0 else 44100 end as rate,
  case when a = 0 or (a > 1 and b > 0) then 'ok' when a = 1 then 'source sample_rate=8000, below minimum 16000' else 'source sample rate could not be established' end as source_message,
  case when a = 3 then 'probe failed' when b = 1 then 'sample_rate=22050, expected 24000' when b = 2 then 'codec=mp3, bits_per_sample=16; expected 24-bit PCM' when secs < 45 then printf('duration=%.2fs below minimum 45.00s', secs) end as failure, b > 2 and a <> 3 as mono_ok from c""")
def capture_gates(spark: SparkSession, d: str) -> DataFrame:
    a, b, secs = F.col("page_id") % 4, F.col("page_id") % 5, F.col("page_id") % 97 + 0.5
    source = rules.source_gate(F.when(a == 0, 22050).when(a == 1, 8000), F.when(b > 0, 44100), 16000)
    failure = rules.output_gate(a != 3, F.lit(None).cast("string"), F.when(b == 1, 22050).otherwise(24000), F.when(b == 2, "mp3").otherwise("pcm_s24le"), F.when(b == 2, 16).otherwise(24), secs, F.lit(50.0), 24000, 0.9)
    streams = F.array(F.struct(F.when(b > 2, "24000").when(b == 2, "x").otherwise("8000").alias("sample_rate"), F.lit(1).alias("channels")))
    return table(spark, d, "pages").select("page_id", source["rate"].alias("rate"), source["message"].alias("source_message"), failure.alias("failure"), I.mono_at_rate(a != 3, streams, 24000).alias("mono_ok"))


@query("manifest_rows", """
with c as (select page_id, page_id % 3 = 0 as refused, page_id % 4 = 0 as short from pages)
select 's/' || page_id || '.json' as path, case when refused then 'source sample_rate=8000, below minimum 16000' when short then 'short' else 'ok' end as message, not refused and not short as valid, case when refused then 0 else page_id end as size,
  'gs://b/raw_24k_s24le/source_id=src' || page_id || '/date=2024-05-01/' || page_id || '.wav' as audio_uri, refused as skipped from c""")
def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    gate = rules.source_gate(F.when(k % 3 == 0, 8000).otherwise(44100), F.lit(0), 16000)
    captures = table(spark, d, "pages").select(
        F.struct(F.concat(F.lit("src"), k).alias("id")).alias("source"), F.lit("2024-05-01T00:00:00Z").alias("started_at"), F.lit("2024-05-01T00:01:00Z").alias("completed_at"), F.lit(60).alias("duration_requested_seconds"), F.lit(60.1234).alias("elapsed_seconds"),
        F.lit(0).alias("returncode"), F.lit("").alias("error"), F.concat(F.lit("s/"), k, F.lit(".wav")).alias("audio_path"), F.concat(F.lit("s/"), k, F.lit(".json")).alias("metadata_path"), k.alias("file_size_bytes"), gate.alias("source_gate"),
        F.when(k % 4 == 0, "short").alias("failure"), F.lit(24000).alias("target_sample_rate"),
    )
    made = rows.manifest_rows(captures, "b", F.lit("2024-05-01"))
    read = F.from_json("manifest", "quality struct<valid:boolean,validation_message:string>, local struct<file_size_bytes:bigint>, gcs struct<audio_uri:string,audio_upload:struct<skipped:boolean>>")
    return made.select("path", read.alias("m")).select("path", F.col("m.quality.validation_message").alias("message"), F.col("m.quality.valid").alias("valid"), F.col("m.local.file_size_bytes").alias("size"), F.col("m.gcs.audio_uri").alias("audio_uri"), F.col("m.gcs.audio_upload.skipped").alias("skipped"))


@query("stream_probe", """
select page_id, case when page_id % 5 = 0 then null else 'mp' || page_id % 4 end as codec, case when page_id % 5 = 0 then null else cast(8000 + page_id % 3 * 1000 as int) end as sample_rate, case when page_id % 7 = 0 then null else cast(page_id % 320 * 1000 as int) end as bitrate from pages""")
def stream_probe(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    log = F.concat(F.when(k % 7 != 0, F.concat(F.lit("Duration: N/A, bitrate: "), k % 320, F.lit(" kb/s\n"))).otherwise("Input\n"), F.when(k % 5 != 0, F.concat(F.lit("  Stream #0:0: Audio: mp"), k % 4, F.lit(", "), 8000 + k % 3 * 1000, F.lit(" Hz, stereo"))).otherwise(""))
    return table(spark, d, "pages").select("page_id", T.log_stream(log).alias("s")).select("page_id", "s.*")


@query("local_first", """
with s as (select event_id, user_id, event_type = 'view' as local, row_number() over (partition by event_type = 'view', user_id order by ts, event_id) as turn from events)
select event_id, user_id, row_number() over (order by not local, turn, user_id) as pos from s""")
def local_first(spark: SparkSession, d: str) -> DataFrame:
    rows_ = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return I.local_first(rows_, F.col("event_type") == "view", "user_id", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", F.col("pos").cast("long").alias("pos"))


@query("duration_batches", "select doc_id, (row_number() over (order by n_chars, doc_id) - 1) // 16 as batch from documents")
def duration_batches(spark: SparkSession, d: str) -> DataFrame:
    return I.duration_batches(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 16).select("doc_id", "batch")


# The label store.
@query("sample_rows", """
select 'u' || doc_id as iu_id, md5(trim(text)) as text_md5, source as source_id, source as source_name, case when doc_id % 3 = 0 then 0.0 else n_chars / 7.0 end::double as duration_seconds, case when doc_id % 5 = 0 then 0 else cast(doc_id % 1000 as int) end as iu_index, -1 as boundary_after_word_index, '' as words_json,
  source || '/' || sha1('u' || doc_id) || '.flac' as audio_path from documents where doc_id % 4 <> 0""")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    units = table(spark, d, "documents").select(
        F.concat(F.lit("u"), k).alias("iu_id"), "text", F.col("source").alias("source_id"), F.lit(None).cast("string").alias("source_name"), F.when(k % 3 == 0, "oops").otherwise((F.col("n_chars") / 7.0).cast("string")).alias("duration_seconds"),
        F.when(k % 5 != 0, (k % 1000).cast("string")).alias("iu_index"), F.when(k % 4 != 0, F.encode(F.lit("x"), "UTF-8")).alias("payload"),
    )
    out = rows.sample_rows(rows.importable(units, F.col("payload")), T.audio_target(F.col("source_id"), F.col("iu_id")), F.lit("now"))
    assert len(out.columns) == 32
    return out.select("iu_id", F.md5("text").alias("text_md5"), "source_id", "source_name", "duration_seconds", "iu_index", "boundary_after_word_index", "words_json", "audio_path")


@query("api_samples", """
select d.doc_id::varchar as iu_id, '/iu/api/audio/' || d.doc_id as audio_url, case d.doc_id % 3 when 0 then 2 else 0 end as n_words, case d.doc_id % 3 when 0 then 'a' end as first_word, l.toxic as note from documents d left join labels l using (doc_id)""")
def api_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    words = F.when(k % 3 == 0, '[{"word":"a","start_seconds":0.5},{"word":"b"}]').when(k % 3 == 1, "not json")
    samples = table(spark, d, "documents").select(k.cast("string").alias("iu_id"), words.alias("words_json"), F.lit("/p").alias("audio_path"))
    notes = table(spark, d, "labels").select(k.cast("string").alias("iu_id"), "toxic")
    out = rows.api_samples(samples, notes, "/iu")
    return out.select("iu_id", "audio_url", F.size("words").alias("n_words"), F.get("words", F.lit(0))["word"].alias("first_word"), F.col("annotation.toxic").alias("note"))


@query("annotation_requests", """
select event_id, case when event_id % 11 = 0 then 'key required' when event_id % 13 = 0 then 'user key too long' when event_id % 17 = 0 then 'confidence out of range' when event_type = 'error' then 'emotion must be one of: neutral, joy, sadness, anger, fear, disgust, surprise, low_quality'
  when event_id % 7 = 0 then 'user key required' end as fault, coalesce(nullif(left(trim(case when event_id % 7 = 0 then ' ' when event_id % 13 = 0 then repeat('x', 130) else 'u' || user_id end), 120), ''), 'anonymous') as annotator from events""")
def annotation_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    user = F.when(k % 7 == 0, " ").when(k % 13 == 0, "x" * 130).otherwise(F.concat(F.lit("u"), "user_id"))
    user_asked = F.when(k % 13 == 0, "x" * 130).when(k % 7 == 0, " ").otherwise(F.concat(F.lit("u"), "user_id"))
    fault = I.request_fault(F.when(F.col("event_type") == "error", "bored").otherwise(" Joy"), user_asked, F.when(k % 11 != 0, "k"), F.lit(""), F.when(k % 17 == 0, 9).otherwise(3))
    return table(spark, d, "events").select("event_id", fault.alias("fault"), T.clean_annotator(user).alias("annotator"))


@query("known_requests", "select 'known' as kind, count(*) as n from events where event_id in (select doc_id from documents) union all select 'unknown', count(*) from events where event_id not in (select doc_id from documents) union all select 'lookup', count(*) from documents where doc_id = 5")
def known_requests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    known, unknown = I.split_known(table(spark, d, "events").select(F.col("event_id").alias("doc_id")), docs, "doc_id")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(known, "known").unionByName(count(unknown, "unknown")).unionByName(count(I.point_lookup(docs, "doc_id", 5), "lookup"))


@query("global_counts", "select count(*) as samples, count(distinct user_id) as users, count(distinct case when event_type = 'view' then user_id end) as viewers from events")
def global_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("samples"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("viewers"))


@query("source_triples", "select source as source_id, upper(source) as source_name, lang as country_code, count(*) as total from documents group by all order by source_id")
def source_triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("source_id"), F.upper("source").alias("source_name"), F.col("lang").alias("country_code")).agg(F.count("*").alias("total")).orderBy("source_id")


@query("user_label_counts", "select event_type as emotion, count(*) as total from events where user_id = 7 group by 1 order by 1")
def user_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.point_lookup(table(spark, d, "events"), "user_id", 7).groupBy(F.col("event_type").alias("emotion")).agg(F.count("*").alias("total")).orderBy("emotion")


@query("retranscripts_merged", r"""
select d.doc_id::varchar as iu_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as original_md5, case d.doc_id % 3 when 0 then 'clip ' || d.doc_id when 1 then 'from words, here' else '' end as text, case d.doc_id % 3 when 0 then 'clip_redecode' when 1 then 'word_offsets_fallback' else 'blank_decode' end as transcript_source,
  case l.toxic when 1 then 'anger' when 0 then 'joy' end as emotion, l.doc_id is not null as is_labeled from documents d left join labels l using (doc_id)""")
def retranscripts_merged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    key = k.cast("string").alias("iu_id")
    cache = docs.select(key, F.when(k % 3 == 0, F.concat(F.lit(" clip  "), k)).otherwise("").alias("text"), F.lit(1.5).alias("elapsed_seconds"))
    labels = table(spark, d, "labels").select(key, F.when(F.col("toxic") == 1, "anger").otherwise("joy").alias("emotion"), F.lit("a").alias("annotator"))
    units = docs.select(key, "text", F.when(k % 3 == 1, '[{"word":"from"},{"word":"words"},{"word":","},{"word":"here"}]').otherwise("[]").alias("words_json"))
    out = L.merge_retranscripts(units, cache, labels)
    return out.select("iu_id", F.md5("original_text").alias("original_md5"), "text", "transcript_source", "emotion", "is_labeled")


@query("unit_rows", r"""
with s as (select conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from conversations where trim(text) <> ''), b as (select conv_id, turn, w, unnest(range(2)) as i from s), u as (select *, least(5.0, i * 3.0) as a, least(5.0, greatest(least(5.0, i * 3.0), (i + 1) * 3.0 - turn)) as e from b)
select 'c' || conv_id || '_' || turn || '#iu=' || lpad(i::varchar, 4, '0') as iu_id, w[i + 1] as text, a::double as start_seconds, round_even(case when e - a < 0.04 then least(5.0, a + 0.04) else e end, 3)::double as end_seconds, case when len(w) > i then 1 else 0 end as n_words from u where w[i + 1] is not null""")
def unit_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("trim(text) <> ''")
    w = F.split(T.collapse(F.col("text"), unicode=False), " ")
    boundary = lambda i: F.struct(F.lit(i).alias("iu_index"), F.get(w, F.lit(i)).alias("text"), F.lit(i * 3.0).alias("start_seconds"), ((i + 1) * 3.0 - F.col("turn")).cast("double").alias("end_seconds"), F.lit(i).alias("start_word_index"), F.lit(i + 1).alias("end_word_index_exclusive"), F.lit(i).alias("boundary_after_word_index"), F.lit(0.5).alias("alignment_score"), F.lit("token_match").alias("alignment_method"), F.struct(F.lit(1).alias("iu_word_count"), F.lit(1.0).alias("speech_rate_wps"), F.lit(-20.0).alias("mean_energy_db"), F.lit(0.0).alias("pause_after_ms")).alias("prosody"))
    segments = c.select(
        F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("segment_id"), F.lit("s").alias("source_id"), F.lit("S").alias("source_name"), F.lit("US").alias("country_code"), F.lit("2024-05-01").alias("recording_date"), F.lit("").alias("started_at"), F.lit(5.0).alias("duration_seconds"),
        F.lit("x/y.flac").alias("audio_path"), F.transform(w, lambda x: F.struct(x.alias("word"))).alias("words"), F.array(boundary(0), boundary(1)).alias("boundaries"), F.lit("m").alias("manifest_path"),
    )
    out = readers.units_of(segments)
    return out.select("iu_id", "text", "start_seconds", "end_seconds", F.size(F.from_json("words_json", "array<struct<word:string>>")).alias("n_words"))


_PUBLIC = "(select d.doc_id, trim(text) as t, source, lang, n_chars / 100.0 as secs, l.doc_id is not null as is_labeled, case when l.doc_id is null then null when quality = 0 then 'low_quality' when toxic = 1 then 'anger' when d.doc_id % 2 = 0 then 'joy' else 'neutral' end as emotion, ['US', 'gb', 'DE', ''][d.doc_id % 4 + 1] as cc from documents d left join labels l using (doc_id))"
_SHOWN = "is_labeled and emotion in ('joy', 'anger') and t <> '' and secs < 20"
_ACCENT = "case upper(cc) when 'US' then 'american' when 'GB' then 'british' else 'unknown' end"


def _public(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    emotion = F.when(F.col("quality").isNull(), None).when(F.col("quality") == 0, "low_quality").when(F.col("toxic") == 1, "anger").when(k % 2 == 0, "joy").otherwise("neutral")
    docs = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("is_labeled", F.lit(True)), "doc_id", "left")
    return docs.select("doc_id", "text", emotion.alias("emotion"), "is_labeled", F.col("source").alias("source_id"), _pick(("US", "gb", "DE", ""), "doc_id", 4).alias("country_code"), (F.col("n_chars") / 100.0).alias("duration_seconds"))


@query("public_rows", f"select doc_id, md5('<|' || emotion || '|> ' || t) as text_md5, {_ACCENT} as accent, source as source_id, coalesce(nullif(cc, ''), 'unknown') as country_code from {_PUBLIC} where {_SHOWN}")
def public_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows.public_rows(_public(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), "accent", "source_id", "country_code")


@query("public_summary", f"""
with p as (select *, {_ACCENT} as accent, coalesce(nullif(cc, ''), 'unknown') as country from {_PUBLIC} where {_SHOWN}),
u as (select 'split' as grouping, emotion as name, secs from p union all select 'accent', accent, secs from p union all select 'source', source, secs from p union all select 'country', country, secs from p union all select 'all', '*', secs from p)
select grouping, name, count(*) as rows, round_even(cast(sum(secs) as double) / 3600, 6) as hours from u group by all
union all select 'removed', 'neutral', count(*), round_even(coalesce(cast(sum(secs) as double), 0) / 3600, 6) from {_PUBLIC} where is_labeled and emotion = 'neutral' and t <> '' and secs < 20""")
def public_summary(spark: SparkSession, d: str) -> DataFrame:
    units = _public(spark, d)
    return P.public_summary(rows.public_rows(units), units)


@query("dataset_card", """
with i as (select count(*) as n, sum(n_chars)::double / 3600 as h, string_agg(distinct '- ' || lang, chr(10) order by '- ' || lang) as l, (select string_agg(x, chr(10) order by x) from (select distinct '- ' || source as x from documents)) as c from documents)
select '---' || chr(10) || 'pretty_name: Docs' || chr(10) || 'task_categories:' || chr(10) || '- automatic-speech-recognition' || chr(10) || '---' || chr(10) || '# Docs' || chr(10) || printf('%d rows, %.3f hours.', n, h) || chr(10) || '## Languages' || chr(10) || l || chr(10) || '## Countries' || chr(10) || c as card from i""")
def dataset_card(spark: SparkSession, d: str) -> DataFrame:
    return sinks.card(sinks.dataset_info(table(spark, d, "documents"), "lang", "source", "n_chars"), "Docs")


@query("class_weights_plain", """
with c as (select cast(v.label as int) as label, greatest(1, count(e.label)) as n, count(e.label) as rows from range(12) v(label) left join embeddings e on e.label = v.label group by 1), r as (select label, rows, pow(sum(n) over () / n, 0.5) as raw from c)
select label, rows as n, round(raw / avg(raw) over (), 6) as weight from r""")
def class_weights_plain(spark: SparkSession, d: str) -> DataFrame:
    out = M.class_weights(table(spark, d, "embeddings").select("label"), "label", list(range(12)), 0.5, one_in_total=True)
    return out.select("label", "n", F.round("weight", 6).alias("weight"))


@query("masked_pooling", """
select label, cast(dim as int) as dim, round(avg(x), 5) as mean, round(sqrt(greatest(var_pop(x), 1e-6)), 5) as std, round(max(x), 5) as max from (select label, unnest(range(64)) as dim, cast(unnest(embedding) as double) as x from embeddings where vec_id % 3 <> 0) group by all""")
def masked_pooling(spark: SparkSession, d: str) -> DataFrame:
    out = G.pool_embeddings(table(spark, d, "embeddings"), ["label"], "embedding", F.col("vec_id") % 3 != 0, 1e-6)
    return out.select("label", "dim", *[F.round(c, 5).alias(c) for c in ("mean", "std", "max")])


@query("meta_store", "select event_type as key, arg_max(event_id, event_id) as value from events group by 1")
def meta_store(spark: SparkSession, d: str) -> DataFrame:
    return L.meta_store(table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("seq")))


@query("refresh_state", "select unnest(['complete', 'refreshing', 'downloading', 'complete', 'downloading']) as state, unnest(range(5)) as at")
def refresh_state(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.count("*")).scalar()
    meta = spark.createDataFrame([("import_complete", "1"), ("revision", "abc")], "key string, value string")
    cases = [(meta, "abc", n), (meta, "xyz", n), (meta, "abc", F.lit(0)), (meta, "", n), (L.cleared(meta), "abc", n)]
    out = None
    for i, (store, revision, count) in enumerate(cases):
        one = I.refresh_needed(store, revision, count).withColumn("at", F.lit(i).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


@query("migrated_annotations", "select event_id, case when event_type = 'error' then 'low_quality' else event_type end as emotion, 0 as low_quality from events")
def migrated_annotations(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "events").select("event_id", F.col("event_type").alias("emotion"), F.when(F.col("event_type") == "error", 1).alias("low_quality"))
    return I.migrated_annotations(old)


@query("queue_members", "select user_id from (select user_id, arg_max(event_type, event_id) as last from events where event_type in ('view', 'purchase') group by 1) where last = 'view'")
def queue_members(spark: SparkSession, d: str) -> DataFrame:
    return L.queue_state(table(spark, d, "events"), "user_id", "event_id", "view", "purchase", "event_type")


@query("validation_rows", "select page_id::varchar as path, page_id % 3 <> 0 as is_valid, case when page_id % 3 = 0 then 'empty file' else 'ok' end as reason from pages order by 1")
def validation_rows(spark: SparkSession, d: str) -> DataFrame:
    why = rules.recording_gate(F.lit(True), F.col("page_id") % 3, F.lit(1800.0), F.lit(1.0), F.lit(0.5))
    return P.validation_rows(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), why.alias("why")), "path", "why")


@query("rates", "select event_id, round_even(event_id % 20 / greatest(value, 0.01), 3) as words_per_second, round(coalesce(event_id * 8 / 1000.0 / nullif(value, 0), 0), 6) as kbps, round(event_id / pow(1024, 3), 9) as gb from events")
def rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", N.words_per_second(F.col("event_id") % 20, F.col("value")).alias("words_per_second"), F.round(N.kbps(F.col("event_id"), F.col("value")), 6).alias("kbps"), F.round(N.gigabytes(F.col("event_id")), 9).alias("gb"))


@query("split_units_lateral", r"""
select conv_id, turn, cast(unnest(range(len(u))) as int) as unit_no, unnest(u) as unit from (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')) || '!!!!! ' || role, '!{5,}'), lambda x: trim(x)), lambda y: y <> '') as u from conversations)""")
def split_units_lateral(spark: SparkSession, d: str) -> DataFrame:
    """A table function in SQL: each text's units."""
    sequential.register_unit_splitter(spark)
    table(spark, d, "conversations").createOrReplaceTempView("_lateral_turns")
    return spark.sql("select conv_id, turn, unit_no, unit from _lateral_turns, lateral split_units(concat(text, '!!!!! ', role))")


@query("collated_turns", "select conv_id, string_agg(role, ',' order by turn) as roles, count(*) as n from conversations group by 1")
def collated_turns(spark: SparkSession, d: str) -> DataFrame:
    out = sequential.collated(table(spark, d, "conversations"), ["conv_id"], "turn", ["role"])
    return out.select("conv_id", F.array_join("role", ",").alias("roles"), F.size("role").cast("long").alias("n"))


@query("merged_settings", "select event_type, 2 as n_keys, 'new' as value, true as stamped from events group by 1")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    """Maps merged, the later value of a key winning, and a stamp of the present moment."""
    kinds = table(spark, d, "events").select("event_type").distinct()
    both = T.merged(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("x")), F.create_map(F.lit("a"), F.lit("new")))
    stamped = dates.iso_now(micros=True).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    return kinds.select("event_type", F.size(both).alias("n_keys"), both["a"].alias("value"), stamped.alias("stamped"))
