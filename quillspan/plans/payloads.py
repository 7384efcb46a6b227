"""Audio payloads made from the tables' vectors: probed, decoded, resampled, cut and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import audio
from quillspan.operators import clips
from quillspan.plans.registry import query, table
from quillspan.sources import rows

_RATE = "case vec_id % 4 when 0 then 16000 when 1 then 8000 when 2 then 22050 else 44100 end"


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """A vector's components as 16-bit samples; the rate goes by vec_id."""
    made = table(spark, d, "embeddings").select("vec_id", "label", F.expr(_RATE).alias("rate"), "embedding")
    return made.withColumn("payload", audio.encoded(F.col("embedding"), F.col("rate")))


def _whole(x: Column) -> Column:
    """Decoded samples as the whole numbers of 16 bits that they were."""
    return F.transform(x, lambda s: F.rint(s.cast("double") * 32768).cast("long"))


_S16 = "list_transform(embedding, lambda x: cast(round_even(cast(x as double) * 32768, 0) as bigint))"
_PLACED = "list_sum(list_transform(range(1, len(s) + 1), lambda i: i * s[i]))"


@query("audio_decode", f"""
with r as (select vec_id, {_RATE} as rate, len(embedding) as n, {_S16} as s from embeddings)
select vec_id, rate, n::double / rate as duration_seconds, cast(ceil(n * 16000.0 / rate) as bigint) as n_samples, case when rate = 16000 then cast({_PLACED} as bigint) end as placed_sum, true as in_range from r""")
def audio_decode(spark: SparkSession, d: str) -> DataFrame:
    """Decoded at 16 kHz; where that is the payload's rate, each sample is the one encoded."""
    got = _recordings(spark, d).withColumn("x", audio.decoded(F.col("payload"), 16000)).withColumn("s", _whole(F.col("x")))
    placed = F.aggregate(F.transform("s", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return got.select(
        "vec_id", "rate", audio.probe(F.col("payload"))["duration_seconds"].alias("duration_seconds"), F.size("x").cast("long").alias("n_samples"),
        F.when(F.col("rate") == 16000, placed).alias("placed_sum"), F.forall("x", lambda v: v.between(-1.0, 1.0)).alias("in_range"),
    )


#: The kinds of payload by vec_id modulo 8: format, channels, bits, bytes of a frame; the others are no audio.
_KINDS = {0: ("wav", 1, 16, 2), 1: ("wav", 2, 24, 6), 2: ("wav", 1, 32, 4), 3: ("wav", 4, 8, 4), 4: ("flac", 2, 24, 0)}
_FLAC_FRAMES = 480_000


def _mixed_payload() -> Column:
    """Payloads of several kinds: widths, channels, a FLAC header, a header cut short, foreign bytes, and none."""
    x, rate, by = F.col("embedding"), F.expr(_RATE), F.col("vec_id") % 8
    # STREAMINFO: block and frame sizes, then rate, channels - 1, bits - 1 and frames packed, and a digest
    packed = F.lpad(F.conv(((rate.cast("long") * 8 + 1) * 32 + 23).cast("string"), 10, 16), 7, "0")
    flac = F.unhex(F.concat(F.lit("664C61430000002210001000000000000000"), packed, F.lpad(F.hex(F.lit(_FLAC_FRAMES).cast("long")), 9, "0"), F.repeat(F.lit("00"), 16)))
    wav = F.when(by == 0, audio.encoded(x, rate)).when(by == 1, audio.encoded(x, rate, 24, 2)).when(by == 2, audio.encoded(x, rate, 32, 1, floats=True)).when(by == 3, audio.encoded(x, rate, 8, 4))
    return wav.when(by == 4, flac).when(by == 5, F.substring(audio.encoded(x, rate), 1, 30)).when(by == 6, F.encode(F.lit("OggS and more"), "UTF-8"))


def _kind(i: int) -> str:
    return "case vec_id % 8 " + " ".join(f"when {k} then {v[i]!r}" for k, v in _KINDS.items()) + " end"


_FRAMES = f"case when vec_id % 8 = 4 then {_FLAC_FRAMES} when vec_id % 8 < 4 then len(embedding) // ({_kind(1)}) end"


@query("audio_probe", f"""
select vec_id, {_kind(0)} as format, case when vec_id % 8 < 5 then {_RATE} end as sample_rate, {_kind(1)} as channels, {_kind(2)} as bits, cast({_FRAMES} as bigint) as frames,
  ({_FRAMES})::double / ({_RATE}) as duration_seconds, case when vec_id % 8 < 4 then len(embedding) // ({_kind(1)}) end as n_samples from embeddings""")
def audio_probe(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "embeddings").select("vec_id", F.expr(_RATE).alias("rate"), _mixed_payload().alias("payload"))
    got = made.withColumn("p", audio.probe(F.col("payload"))).withColumn("x", audio.decoded(F.col("payload"), 16000))
    seconds = F.when(F.col("x").isNotNull(), F.col("p.frames"))
    return got.select("vec_id", *[F.col(f"p.{c}").alias(c) for c in ("format", "sample_rate", "channels", "bits", "frames", "duration_seconds")], seconds.alias("n_samples"))


@query("header_seconds", f"""
select vec_id, coalesce(case vec_id % 3 when 0 then 1.5 when 1 then case when vec_id % 2 = 0 then 2.0 end end, ({_FRAMES})::double / ({_RATE})) as seconds from embeddings""")
def header_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of a row: the first column that reads as a number, else what the payload's header says."""
    made = table(spark, d, "embeddings").select(
        "vec_id", F.expr("case vec_id % 3 when 0 then '1.5' when 1 then 'unknown' end").alias("duration_seconds"), F.expr("case when vec_id % 2 = 0 and vec_id % 3 = 1 then 2.0 end").alias("duration"), _mixed_payload().alias("payload")
    )
    return made.select("vec_id", rows.usable_seconds(made, audio.probe(F.col("payload"))["duration_seconds"]).alias("seconds"))


@query("unit_clips", f"""
with u as (select vec_id, label, unnest([0, 1, 2, 3]) as unit, {_S16} as s from embeddings),
b as (select *, case unit when 0 then 0 when 1 then 16 when 2 then 32 else 60 end as a, case unit when 0 then 64 when 1 then 48 when 2 then 64 else 64 end as z from u where unit <> 2 or vec_id % 2 = 0)
select vec_id, unit, 'l' || label || '/2024-01-01/v' || vec_id || '_iu000' || unit || '.wav' as path, z - a as n_samples, (z - a) / 800.0::double as duration_seconds,
  cast(list_sum(list_transform(range(1, z - a + 1), lambda i: i * s[a + i])) as bigint) as placed_sum from b""")
def unit_clips(spark: SparkSession, d: str) -> DataFrame:
    """Units of a recording of 80 ms at 800 Hz: the whole, a part, one of less than 40 ms that is widened, and one at the end."""
    made = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("l"), "label").alias("source"), F.lit("2024-01-01").alias("date"), F.concat(F.lit("a/v"), "vec_id", F.lit(".flac")).alias("path"), F.lit(0.08).alias("seconds"), audio.encoded(F.col("embedding"), F.lit(800)).alias("payload"))
    spans = F.array(*[F.struct(F.lit(i).alias("unit"), F.lit(t).alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, t, a, b in ((0, "all of it", -1.0, 9.0), (1, " a  part ", 0.02, 0.06), (2, "short", 0.04, 0.041), (3, "the end", 0.075, 0.08))])
    units = table(spark, d, "embeddings").select("vec_id", F.explode(spans).alias("u")).select("vec_id", "u.unit", F.when((F.col("u.unit") != 2) | (F.col("vec_id") % 2 == 0), F.col("u.text")).alias("text"), "u.start", "u.end")
    got = clips.unit_clips(made, units, "vec_id").withColumn("s", _whole(audio.decoded(F.col("audio.bytes"), 800)))
    placed = F.aggregate(F.transform("s", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return got.select("vec_id", "unit", F.col("audio.path").alias("path"), F.size("s").cast("long").alias("n_samples"), "duration_seconds", placed.alias("placed_sum"))


@query("concat_clips", f"""
with v as (select vec_id // 5 as grp, vec_id % 5 as k, {_S16} as s from embeddings),
g as (select grp, count(*) as n, list(s order by k) as parts from v group by 1),
l as (select grp, n, flatten(list_transform(range(1, n + 1), lambda i: case when i = 1 then parts[i] else list_concat(list_transform(range(1280), lambda z: 0::bigint), parts[i]) end)) as s from g)
select grp as group_no, 'concat_iu/' || lpad(cast(grp as varchar), 7, '0') || '.wav' as path, n as iu_count, len(s) / 16000.0::double as duration_seconds, 44 + 2 * len(s) as n_bytes,
  cast(list_sum(list_transform(range(1, len(s) + 1), lambda i: i * s[i])) as bigint) as placed_sum from l""")
def concat_clips(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("group_no"), (F.col("vec_id") % 5).alias("k"), audio.encoded(F.col("embedding"), F.lit(16000)).alias("payload"))
    got = clips.concat_clips(units, "group_no", "k", "payload").withColumn("s", _whole(audio.decoded(F.col("audio.bytes"), 16000)))
    placed = F.aggregate(F.transform("s", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return got.select("group_no", F.col("audio.path").alias("path"), "iu_count", "duration_seconds", F.length("audio.bytes").cast("long").alias("n_bytes"), placed.alias("placed_sum"))
