"""Clips of recordings: cut at units, and laid end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import audio
from quillspan.functions import text as T


def clip_path(source: Column, date: Column, recording: Column, unit: Column) -> Column:
    """``source/date/stem_iu0007.wav``."""
    stem = F.regexp_replace(F.element_at(F.split(recording, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(source, F.lit("/"), date, F.lit("/"), stem, F.lit("_iu"), F.lpad(unit.cast("string"), 4, "0"), F.lit(".wav"))


def unit_clips(recordings: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, unit, text, audio struct(bytes, path), duration_seconds), a row for each unit with a text and samples left.

    ``recordings`` (key, source, date, path, payload, seconds), a row for each key; ``units`` (key, unit, text, start, end). A recording meets its units
    once, as an array of spans, and is decoded once, so payloads are not repeated for each unit. A null bound is the recording's start.
    """
    said = T.collapse(F.col("text"))
    spans = units.where(F.coalesce(said, F.lit("")) != "").select(F.col(key).alias("_key"), F.struct("unit", said.alias("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).alias("_u"))
    grouped = spans.groupBy("_key").agg(F.array_sort(F.collect_list("_u")).alias("_us"))
    cut = recordings.join(grouped, F.col(key) == F.col("_key")).withColumn("_clips", audio.clips(F.col("payload"), F.transform("_us", lambda u: F.struct(u["start"], u["end"])), F.col("seconds")))
    each = cut.select(key, "source", "date", "path", F.explode(F.arrays_zip("_us", "_clips")).alias("_z")).where("_z._clips is not null")
    each = each.select(key, "source", "date", "path", F.col("_z._us.unit").alias("unit"), F.col("_z._us.text").alias("text"), F.col("_z._clips").alias("_bytes"))
    made = F.struct(F.col("_bytes").alias("bytes"), clip_path(F.col("source"), F.col("date"), F.col("path"), F.col("unit")).alias("path"))
    return each.select(key, "unit", "text", made.alias("audio"), audio.probe(F.col("_bytes"))["duration_seconds"].alias("duration_seconds"))


def concat_clips(units: DataFrame, group: str, order: str, payload: str, rate: int = 16000, gap_ms: float = 80.0) -> DataFrame:
    """Groups of clips end to end with silence between: (group, audio struct(bytes, path), duration_seconds, iu_count).

    Groups come from packing, so they hold a few clips and less than a minute. A group with a clip that cannot be decoded has a null audio.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(payload).alias("_p"))))
    line = units.groupBy(group).agg(rows.alias("_r"), F.count("*").alias("iu_count")).withColumn("_line", audio.concatenated(F.transform("_r", lambda r: r["_p"]), rate, gap_ms))
    path = F.concat(F.lit("concat_iu/"), F.lpad(F.col(group).cast("string"), 7, "0"), F.lit(".wav"))
    made = F.when(F.col("_line").isNotNull(), F.struct(F.col("_line.bytes").alias("bytes"), path.alias("path")))
    return line.select(group, made.alias("audio"), F.col("_line.duration_seconds").alias("duration_seconds"), "iu_count")
