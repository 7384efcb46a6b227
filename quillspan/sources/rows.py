"""Row constructors: captures to metadata and shard rows, units to label-store samples, manifests, and the adapters of mixture sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import numbers as N
from quillspan.functions import text as T
from quillspan.functions import vocab
from quillspan.operators import rules


def recording_date(completed: Column, started: Column) -> Column:
    """The date of the first stamp that is there, as it stands in it; empty where neither has one."""
    day = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) >= 10, F.left(c, F.lit(10)))
    return F.coalesce(day(completed), day(started), F.lit(""))


_STATION_COLUMNS = {
    "station_name": "name", "station_uuid": "stationuuid", "country": "country", "country_code": "countrycode", "language": "language_canonical", "language_raw": "language",
    "tags": "tags", "votes": "votes", "codec_original": "codec", "bitrate_original": "bitrate", "homepage": "homepage",
}


def metadata_rows(results: DataFrame, base: str, sample_rate: int = 16000, channels: int = 1) -> DataFrame:
    """Successful recordings (station, filepath, ...) as 19 columns of metadata, audio paths relative to ``base``."""
    good = results.where("success and coalesce(filepath, '') <> ''")
    return good.select(
        T.relative_path(F.col("filepath"), base).alias("audio"), *[F.col(f"station.{c}").alias(name) for name, c in _STATION_COLUMNS.items()],
        F.col("duration_actual").cast("double").alias("duration_seconds"), F.col("file_size_bytes").cast("long").alias("file_size_bytes"), recording_date(F.col("completed_at"), F.col("started_at")).alias("recording_date"),
        F.lit(sample_rate).alias("sample_rate"), F.lit(channels).alias("channels"), F.col("silence_ratio").cast("double").alias("silence_ratio"), F.col("peak_amplitude").cast("double").alias("peak_amplitude"),
    )


def shard_rows(results: DataFrame, audio: Column, size: Column) -> DataFrame:
    """Recordings as rows of a shard: duration half-even to a tenth of a second, the date from the completion stamp."""
    return results.select(
        audio.alias("audio"), *[(F.trim(F.col(f"station.{c}")) if name == "station_name" else F.col(f"station.{c}")).alias(name) for name, c in _STATION_COLUMNS.items()],
        F.bround("duration_actual", 1).alias("duration_seconds"), size.alias("file_size_bytes"), F.left("completed_at", F.lit(10)).alias("recording_date"), F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"),
    )


def metadata_only(rows: DataFrame) -> DataFrame:
    return rows.drop("audio")


def output_paths(df: DataFrame, root: str, extension: str = "flac") -> DataFrame:
    """Where a station's recording goes: root/country/language/uuid.ext."""
    ext = extension.removeprefix(".").lower() or "flac"
    return df.withColumn("output_path", F.concat_ws("/", F.lit(root), "countrycode", "language_canonical", F.concat("stationuuid", F.lit(f".{ext}"))))


#: Folder and ending of each kind of a segment's files.
SEGMENT_FILES = {"record": ("records", ".json"), "failure": ("failures", ".json"), "stripped": ("audio_16k_flac", "_16k.flac"), "raw": ("raw_cache", ".wav")}


def segment_path(kind: str, root: str, source: Column, date: Column, stem: Column) -> Column:
    folder, ending = SEGMENT_FILES[kind]
    return F.concat_ws("/", F.lit(root), F.lit(folder), source, date, F.concat(stem, F.lit(ending)))


def bucket_uri(bucket: str) -> str:
    return bucket.rstrip("/") if bucket.startswith("gs://") else f"gs://{bucket.strip('/')}"


def object_uri(bucket: str, prefix: str, source: Column, date: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit(bucket_uri(bucket)), F.lit(prefix), F.concat(F.lit("source_id="), source), F.concat(F.lit("date="), date), F.element_at(F.split(path, "/"), -1))


def audio_struct(payload: Column, path: Column, source: Column, index: Column) -> Column:
    """struct(bytes, path) with the path ``source/0000007.ext``; null without a payload."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    suffix = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    made = F.struct(payload.alias("bytes"), F.concat(source, F.lit("/"), F.lpad(index.cast("string"), 7, "0"), F.coalesce(F.nullif(suffix, F.lit("")), F.lit(".wav"))).alias("path"))
    return F.when(payload.isNotNull() & (F.length(payload) > 0), made)


def usable_seconds(df: DataFrame, header: Column | None = None) -> Column:
    """The first of duration_seconds, duration and Duration that reads as a number, else what the audio's header says."""
    known = [F.col(c).cast("string").try_cast("double") for c in ("duration_seconds", "duration", "Duration") if c in df.columns]
    return F.coalesce(*known, header if header is not None else F.lit(None).cast("double"))


def _acted_file(c: Column) -> tuple[Column, Column]:
    parts = F.split(F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1), "_")
    return F.coalesce(T.lookup(vocab.ACTED_SENTENCES, F.get(parts, F.lit(1))), F.lit("")), T.lookup(vocab.ACTED_EMOTIONS, F.get(parts, F.lit(2)))


def _statement(c: Column) -> Column:
    said = T.collapse(c)
    return F.coalesce(T.lookup(vocab.ACTED_STATEMENTS, said), T.lookup(vocab.ACTED_STATEMENTS, F.lower(said)), said)


#: Text and label of each kind of mixture source, from its own columns.
ADAPTERS: Mapping[str, Callable[[], tuple[Column, Column]]] = {
    "radio": lambda: (F.col("text"), F.col("emotion")),
    "transcribed": lambda: (F.col("transcription"), F.col("major_emotion")),
    "acted_file": lambda: (_acted_file(F.col("file"))[0], F.coalesce(F.nullif(F.col("emotion"), F.lit("")), _acted_file(F.col("file"))[1])),
    "spoken_word": lambda: (T.say_the_word(F.col("path")), F.col("label")),
    "dialogue": lambda: (F.col("Utterance"), F.col("Emotion")),
    "statement": lambda: (_statement(F.col("statement")), F.col("emotion")),
}


def adapted(df: DataFrame, kind: str, source: str, index: str, payload: Column, path: Column, least: float, most: float, header: Column | None = None) -> DataFrame:
    """A source's rows as (source, source_index, audio, target, label, duration_seconds, skip_reason).

    ``skip_reason`` is the first rule that a row fails, or null; statements that are sung and not spoken are the first to go.
    """
    text, label = ADAPTERS[kind]()
    seconds = usable_seconds(df, header)
    asked = list(rules.mixture_rules(label, text, seconds, payload, least, most))
    if kind == "statement":
        channel = F.lower(T.collapse(F.col("vocal_channel")))
        asked = [("non_speech", (channel != "") & (channel != "speech")), *asked]
    return df.select(
        F.lit(source).alias("source"), F.col(index).alias("source_index"), audio_struct(payload, path, F.lit(source), F.col(index)).alias("audio"),
        F.concat_ws(" ", T.token_of_label(label), T.strip_leading_token(T.collapse(text))).alias("target"), T.normal_label(label).alias("label"), seconds.alias("duration_seconds"), rules.first_reason(asked).alias("skip_reason"),
    )


def chain_splits(splits: Mapping[str, DataFrame], name: str = "split") -> DataFrame:
    """All splits of a dataset under one schema, with the split's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(split)) for split, df in splits.items()])


#: Columns of a label-store sample with their kinds; numbers that cannot be read get the default.
SAMPLE = {
    **dict.fromkeys(("iu_id", "text", "source_id", "source_name", "country_code", "recording_date", "started_at", "segment_id", "raw_uri", "rights_status", "asr_model", "unit_model"), ("string", "")),
    "segment_duration_seconds": ("double", 0.0), "iu_index": ("int", 0), "start_seconds": ("double", 0.0), "end_seconds": ("double", 0.0), "duration_seconds": ("double", 0.0), "start_word_index": ("int", 0),
    "end_word_index_exclusive": ("int", 0), "boundary_after_word_index": ("int", -1), "alignment_score": ("double", 0.0), "alignment_method": ("string", ""), "iu_word_count": ("int", 0),
    **dict.fromkeys(("speech_rate_wps", "mean_energy_db", "pause_before_ms", "pause_after_ms"), ("double", 0.0)), **dict.fromkeys(("boundary_strength", "words_json", "manifest_path"), ("string", "")),
}


def sample_rows(units: DataFrame, audio_path: Column, imported_at: Column) -> DataFrame:
    """Units as the 32 columns of a label-store sample; a column that is missing or null gets its default."""
    have = lambda c: F.col(c) if c in units.columns else F.lit(None)
    out = {c: F.coalesce(have(c).cast("string"), F.lit("")) if kind == "string" else N.lenient(have(c).cast("string"), kind, default) for c, (kind, default) in SAMPLE.items()}
    out["text"] = F.trim(out["text"])
    out["source_name"] = F.coalesce(F.nullif(out["source_name"], F.lit("")), out["source_id"])
    return units.select(*[c.alias(name) for name, c in out.items()], audio_path.alias("audio_path"), imported_at.alias("imported_at"))


def importable(units: DataFrame, payload: Column) -> DataFrame:
    """Units with an id and audio."""
    return units.where((F.coalesce("iu_id", F.lit("")) != "") & payload.isNotNull() & (F.length(payload) > 0))


def api_samples(samples: DataFrame, annotations: DataFrame, prefix: str) -> DataFrame:
    """Samples as the service gives them: no path but a URL, words parsed (none where the JSON is broken), and the annotation or null."""
    words = F.coalesce(F.from_json("words_json", "array<struct<word:string,start_seconds:double,end_seconds:double>>"), F.array())
    noted = annotations.select(F.col("iu_id").alias("_key"), F.struct("*").alias("annotation"))
    return samples.join(noted, samples["iu_id"] == noted["_key"], "left").drop("_key", "audio_path").withColumn("audio_url", F.concat(F.lit(f"{prefix}/api/audio/"), "iu_id")).withColumn("words", words)


def manifest_rows(captures: DataFrame, bucket: str, date: Column, bit_depth: int = 24, channels: int = 1) -> DataFrame:
    """Captures as manifests, one JSON text each; a capture whose source was refused has no file and was not uploaded.

    ``captures``: source struct, started_at, completed_at, duration_requested_seconds, elapsed_seconds, returncode, error, audio_path, metadata_path,
    file_size_bytes, source_gate struct(ok, message, rate), failure (null for a good capture), target_sample_rate.
    """
    refused = ~F.col("source_gate.ok")
    message = F.when(refused, F.col("source_gate.message")).otherwise(F.coalesce("failure", F.lit("ok")))
    manifest = F.struct(
        "source",
        F.struct("started_at", "completed_at", "duration_requested_seconds", F.when(refused, 0.0).otherwise(F.bround("elapsed_seconds", 3)).alias("elapsed_seconds"), F.when(~refused, F.col("returncode")).alias("returncode"), F.when(refused, F.col("source_gate.message")).otherwise(F.col("error")).alias("error")).alias("capture"),
        F.struct("audio_path", "metadata_path", F.when(refused, 0).otherwise(F.col("file_size_bytes")).alias("file_size_bytes")).alias("local"),
        F.struct(
            F.col("source_gate.rate").alias("source_sample_rate_hz"), F.col("source_gate.ok").alias("source_quality_valid"), F.col("source_gate.message").alias("source_quality_message"), (message == "ok").alias("valid"),
            message.alias("validation_message"), F.col("target_sample_rate").alias("target_sample_rate_hz"), F.lit(bit_depth).alias("target_bit_depth"), F.lit(channels).alias("target_channels"),
        ).alias("quality"),
        F.struct(
            F.lit(bucket_uri(bucket)).alias("bucket"), object_uri(bucket, "raw_24k_s24le", F.col("source.id"), date, F.col("audio_path")).alias("audio_uri"), object_uri(bucket, "manifests", F.col("source.id"), date, F.col("metadata_path")).alias("metadata_uri"),
            *[F.struct(F.lit(False).alias("ok"), refused.alias("skipped")).alias(c) for c in ("audio_upload", "metadata_upload")],
        ).alias("gcs"),
    )
    return captures.select(F.col("metadata_path").alias("path"), F.to_json(manifest).alias("manifest"))


def public_rows(units: DataFrame, most_seconds: float = 20.0) -> DataFrame:
    """Labelled units with a known emotion that is not neutral or low quality, as (text with token, accent, and what they count by)."""
    shown = [x for x in vocab.LABELS_WITH_LOW_QUALITY if x not in ("neutral", "low_quality")]
    said = F.trim(F.coalesce("text", F.lit("")))
    kept = units.where(F.coalesce("is_labeled", F.lit(False)) & F.col("emotion").isin(*shown) & (said != "") & (F.coalesce("duration_seconds", F.lit(0.0)) < most_seconds))
    return kept.select(
        *[c for c in kept.columns if c not in ("text", "source_id", "country_code")], F.concat(F.lit("<|"), "emotion", F.lit("|> "), said).alias("text"), T.accent_of_country(F.col("country_code")).alias("accent"),
        T.falsy(F.col("source_id"), "unknown").alias("source_id"), T.falsy(F.col("country_code"), "unknown").alias("country_code"),
    )


def concat_rows(units: DataFrame, group: str, order: str, gap: float = 0.08) -> DataFrame:
    """Groups of units laid end to end: (group, text, duration_seconds, iu_count, source_paths, source_counts_json, emotion_counts_json).

    ``units`` (group, order, body, token, source, source_path, seconds); a group is a handful of units. The text is body and token in turn.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, "body", "token", "source_path")))
    one = units.groupBy(group).agg(rows.alias("_r"), (F.sum("seconds") + (F.count("*") - 1) * gap).alias("duration_seconds"), F.count("*").alias("iu_count"))

    def counts(by: str) -> DataFrame:
        n = units.groupBy(group, by).agg(F.count("*").alias("n"))
        return n.groupBy(group).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "n"))))).alias("j"))

    out = one.join(counts("source").withColumnRenamed("j", "source_counts_json"), group).join(counts("token").withColumnRenamed("j", "emotion_counts_json"), group)
    text = F.array_join(F.flatten(F.transform("_r", lambda r: F.array(r["body"], r["token"]))), " ")
    return out.select(group, text.alias("text"), "duration_seconds", "iu_count", F.transform("_r", lambda r: r["source_path"]).alias("source_paths"), "source_counts_json", "emotion_counts_json")
