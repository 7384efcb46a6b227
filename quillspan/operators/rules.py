"""Ordered rules: each row gets the first reason that fits it, and nothing is lost on the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import vocab

#: (reason or an expression giving one, when it fits), in the order in which they are asked.
Rules = Sequence[tuple[str | Column, Column]]


def first_reason(rules: Rules) -> Column:
    """The first fitting rule's reason, or null."""
    out = F.lit(None).cast("string")
    for reason, when in reversed(list(rules)):
        out = F.when(F.coalesce(when, F.lit(False)), F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return out


def with_reason(df: DataFrame, rules: Rules, name: str = "drop_reason") -> DataFrame:
    return df.withColumn(name, first_reason(rules))


def accepted(df: DataFrame, rules: Rules) -> DataFrame:
    return with_reason(df, rules, "_reason").where("_reason is null").drop("_reason")


def reason_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows by reason, kept ones under ``kept``; the counts add up to the input."""
    return with_reason(df, rules).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def token_rules(emotion: Column, text: Column, seconds: Column, payload: Column, most_seconds: float) -> Rules:
    """Rules of the token set: label present, usable and known, duration below the limit, text and payload there."""
    label = F.trim(F.coalesce(emotion, F.lit("")))
    known = [x for x in vocab.LABELS_WITH_LOW_QUALITY if x != "low_quality"]
    return [
        ("unlabeled", label == ""),
        ("low_quality", label == "low_quality"),
        (F.concat(F.lit("unknown_emotion:"), label), ~label.isin(*known)),
        ("duration_gte_limit", F.coalesce(seconds, F.lit(0.0)) >= most_seconds),
        ("empty_text", F.trim(F.coalesce(text, F.lit(""))) == ""),
        ("missing_audio", payload.isNull() | (F.length(payload) == 0)),
    ]


def mixture_rules(label: Column, text: Column, seconds: Column, payload: Column, least: float, most: float) -> Rules:
    """Rules of a mixture source; the upper duration bound is exclusive."""
    return [
        ("unknown_label", T.normal_label(label).isNull()),
        ("empty_text", T.strip_leading_token(T.collapse(text)) == ""),
        ("duration", ~((seconds >= least) & (seconds < most)) | seconds.isNull()),
        ("missing_audio_bytes", payload.isNull() | (F.length(payload) == 0)),
    ]


def concat_rules(audio: Column, payload: Column, text: Column, seconds: Column, least: float, most: float) -> Rules:
    """Rules of the concatenation input; the upper duration bound is inclusive."""
    return [
        ("missing_audio", audio.isNull()),
        ("missing_audio_payload", payload.isNull() | (F.length(payload) == 0)),
        ("missing_emotion_token", T.primary_token(text).isNull()),
        ("empty_body", T.strip_tokens(text) == ""),
        ("iu_duration", ~seconds.between(least, most) | seconds.isNull()),
    ]


def output_gate(ok: Column, error: Column, rate: Column, codec: Column, bits: Column, seconds: Column, expected: Column, want_rate: int, least_ratio: float) -> Column:
    """Why a capture fails, or null. A duration of zero passes, as it stands for an unknown one."""
    short = expected * least_ratio
    return first_reason([
        (F.coalesce(F.nullif(error, F.lit("")), F.lit("probe failed")), ~F.coalesce(ok, F.lit(False))),
        (F.concat(F.lit("sample_rate="), rate, F.lit(f", expected {want_rate}")), rate != want_rate),
        (F.concat(F.lit("codec="), codec, F.lit(", bits_per_sample="), bits, F.lit("; expected 24-bit PCM")), (codec != "pcm_s24le") & (bits < 24)),
        (F.format_string("duration=%.2fs below minimum %.2fs", seconds, short), (seconds != 0) & (seconds < short)),
    ])


def source_gate(probe_rate: Column, catalog_rate: Column, least: int) -> Column:
    """struct(ok, message, rate): the probed rate, else the catalogue's."""
    rate = F.coalesce(F.when(probe_rate > 0, probe_rate), catalog_rate, F.lit(0))
    message = F.when(rate <= 0, "source sample rate could not be established").when(rate < least, F.concat(F.lit("source sample_rate="), rate, F.lit(f", below minimum {least}"))).otherwise("ok")
    return F.struct((message == "ok").alias("ok"), message.alias("message"), rate.alias("rate"))


def recording_gate(exists: Column, size: Column, seconds: Column, silence: Column, peak: Column, least_seconds: float = 1700.0, most_silence: float = 0.5) -> Column:
    """Why a recording fails, or null."""
    share = F.try_divide(silence, seconds)
    return first_reason([
        ("file not found", ~F.coalesce(exists, F.lit(False))),
        ("empty file", size <= 0),
        ("could not read duration", seconds.isNull() | (seconds <= 0)),
        (F.format_string(f"duration %.1fs below minimum {least_seconds}s", seconds), seconds < least_seconds),
        (F.format_string(f"silence ratio %.2f exceeds max {most_silence}", share), share > most_silence),
        (F.format_string("peak amplitude %.6f below threshold", peak), peak < 0.001),
    ])
