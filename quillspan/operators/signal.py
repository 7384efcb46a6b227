"""Ordered-sequence operators: runs, islands, frames, intervals, offsets and pooling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import numbers as N
from quillspan.operators.rank import group_quantiles
from quillspan.operators.scan import fits, scan, with_halo

#: Positions that one task holds of a key, at least.
BLOCK = 65_536


def leading_run(df: DataFrame, keys: Sequence[str], order: Sequence[Column], loud: Column, name: str = "run") -> DataFrame:
    """How many rows of each group come before its first loud one (all of them where none is).

    Two sums by group: where its first loud row is, and how many rows come before; no group is gathered.
    """
    placed = df.select(*keys, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_at"), loud.alias("_loud"))
    first = placed.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min(F.when(F.col("_loud"), F.col("_at"))).alias("_first"))
    both = placed.join(first, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]))
    return both.groupBy(*keys).agg(F.sum((F.col("_first").isNull() | (F.col("_at") < F.col("_first"))).cast("long")).alias(name))


def near_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, reach: float) -> DataFrame:
    """Pairs of rows of one key whose positions are at most ``reach`` apart.

    The axis is cut into buckets of that length; a left row meets the right rows of its own bucket and the two beside it, so a key's rows
    are dealt out by position and not all compared.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(reach) or 1.0))
    spread = left.withColumn("_bucket", F.explode(F.array(*[bucket(at) + i for i in (-1, 0, 1)])))
    return spread.join(right.withColumn("_bucket", bucket(other)), [*keys, "_bucket"]).drop("_bucket").where(F.abs(F.col(at) - F.col(other)) <= reach)


def within_spans(spans: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str, at: str, width: float) -> DataFrame:
    """Points of one key that lie in a span, ends included; the axis is cut into buckets of ``width``, about a span's length."""
    bucket = lambda c: F.floor(F.col(c) / float(width))
    spread = spans.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return spread.join(points.withColumn("_bucket", bucket(at)), [*keys, "_bucket"]).drop("_bucket").where(F.col(at).between(F.col(start), F.col(end)))


def silence_around(frames: DataFrame, boundaries: DataFrame, key: str, threshold: float, reach: float = 0.8, hop_ms: float = 10.0) -> DataFrame:
    """Silence in ms before and after each boundary (key, boundary_id, at): frames at or below the threshold without a gap.

    ``frames`` (key, t, rms). A range join brings each boundary its frames within ``reach`` seconds.
    """
    near = near_join(boundaries, frames, [key], "at", "t", reach)
    sides = near.select(key, "boundary_id", "at", "t", "rms", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("side")).where(
        F.expr("side = 'before' and t <= at or side = 'after' and t >= at")
    )
    runs = leading_run(sides, [key, "boundary_id", "side"], [F.abs(F.col("t") - F.col("at")), F.col("t")], F.col("rms") > threshold)
    wide = runs.groupBy(key, "boundary_id").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("run"))), F.lit(0)).alias(s) for s in ("before", "after")])
    return boundaries.join(wide, [key, "boundary_id"], "left").select(key, "boundary_id", *[F.bround(F.coalesce(s, F.lit(0)) * hop_ms, 1).alias(f"pause_{s}_ms") for s in ("before", "after")])


def island_peaks(df: DataFrame, keys: Sequence[str], idx: str, value: str, threshold: float) -> DataFrame:
    """Of each run of neighbouring rows with value >= threshold, the first row of the largest value; with the run's size."""
    active = scan(df.where(F.col(value) >= threshold), keys, [F.col(idx)], sums={"_n": F.lit(1)})
    islands = active.withColumn("_island", F.col(idx) - F.col("_n"))
    return islands.groupBy(*keys, "_island").agg(F.max(F.struct(F.col(value), (-F.col(idx)).alias("_neg"))).alias("_m"), F.count("*").alias("frames")).select(
        *keys, (-F.col("_m._neg")).alias(idx), F.col(f"_m.{value}").alias(value), "frames"
    )


def tumbling(df: DataFrame, keys: Sequence[str], pos: str, size: int, least: int, aggregates: Sequence[Column]) -> DataFrame:
    """Chunks of ``size`` positions; those with fewer than ``least`` rows go."""
    return df.withColumn("chunk", F.floor(F.col(pos) / size).cast("long")).groupBy(*keys, "chunk").agg(F.count("*").alias("n"), *aggregates).where(F.col("n") >= least)


def cut_plan(df: DataFrame, keys: Sequence[str], seconds: str, length: float) -> DataFrame:
    """(keys..., chunk, start_seconds, end_seconds): a recording in chunks of ``length`` seconds from 0, the last one shorter; none without a duration."""
    n = F.ceil(F.col(seconds) / length).cast("long")
    each = df.where(F.col(seconds) > 0).select(*keys, F.col(seconds).cast("double").alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return each.select(*keys, "chunk", (F.col("chunk") * length).alias("start_seconds"), F.least(F.col("_s"), (F.col("chunk") + 1) * length).alias("end_seconds"))


def sliding_rms(df: DataFrame, keys: Sequence[str], pos: str, value: str, frame: int, hop: int, block: int = BLOCK) -> DataFrame:
    """Root mean square of full frames of ``frame`` rows that start every ``hop`` rows; ``pos`` counts from 0.

    A key's rows are framed in blocks of positions, each with the rows that its last frames reach into, so a key is many tasks.
    """
    ahead = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(0, frame - 1)
    rows = with_halo(df.select(*keys, pos, value), pos, max(block, frame), frame - 1)
    out = rows.withColumn("_n", F.count("*").over(ahead)).withColumn("rms", F.sqrt(F.avg(F.col(value) * F.col(value)).over(ahead)))
    return out.where(F.col("_own") & (F.col(pos) % hop == 0) & (F.col("_n") == frame)).select(*keys, pos, "rms")


def silence_stats(df: DataFrame, keys: Sequence[str], rms: str) -> DataFrame:
    """Threshold max(1.5 p20, median/4, 1e-4), mean and peak, and the share of frames at or below the threshold."""
    stats = df.groupBy(*keys).agg(F.avg(rms).alias("mean_rms"), F.max(rms).alias("peak"))
    stats = stats.join(group_quantiles(df, keys, rms, {"p20": 0.2, "p50": 0.5}), list(keys))
    stats = stats.withColumn("threshold", F.greatest(F.col("p20") * 1.5, F.col("p50") * 0.25, F.lit(1e-4)))
    share = df.join(stats.select(*keys, "threshold"), list(keys)).groupBy(*keys).agg(F.avg((F.col(rms) <= F.col("threshold")).cast("double")).alias("silence_ratio"))
    return stats.join(share, list(keys)).withColumn("mean_rms_db", N.decibel(F.col("mean_rms"))).withColumn("peak_db", N.decibel(F.col("peak")))


def pair_intervals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], kind: str, value: str, start: str, end: str, close_at: Column | None = None) -> DataFrame:
    """Each start event with the end event right after it; a last open one ends at ``close_at`` or is left out."""
    ahead = scan(df.where(F.col(kind).isin(start, end)), keys, order, after={"_next": F.col(kind), "_end": F.col(value)})
    closed = F.when(F.col("_next") == end, F.col("_end"))
    if close_at is not None:
        closed = F.coalesce(closed, F.when(F.col("_next").isNull(), close_at))
    return ahead.where(F.col(kind) == start).withColumn("interval_end", closed).where("interval_end is not null").select(*keys, F.col(value).alias("interval_start"), "interval_end")


def spread_targets(df: DataFrame, keys: Sequence[str], at: str, length: str, width: int) -> DataFrame:
    """Distinct frames within ``width`` of each event, inside [0, length)."""
    span = F.sequence(F.greatest(F.lit(0), F.col(at) - width), F.least(F.col(length) - 1, F.col(at) + width))
    return df.where(F.col(at).between(0, F.col(length) - 1)).select(*keys, F.explode(span).alias("frame")).distinct()


def frame_of(share: Column, frames: Column) -> Column:
    """Frame index of a share of the clip, half-even rounded and clamped."""
    return F.least(frames - 1, F.greatest(F.lit(0), F.bround(share * (frames - 1), 0))).cast("long")


def running_offsets(df: DataFrame, keys: Sequence[str], order: str, length: str, gap: int) -> DataFrame:
    """Start and end of each part when a group's parts are laid end to end with gaps between."""
    out = scan(df, keys, [F.col(order)], sums={"_end": F.col(length) + gap})
    return out.withColumn("end_at", F.col("_end") - gap).drop("_end").withColumn("start_at", F.col("end_at") - F.col(length))


def pool_embeddings(df: DataFrame, keys: Sequence[str], vector: str, mask: Column | None = None, least_variance: float | None = None) -> DataFrame:
    """Mean, population deviation and maximum by dimension (key..., dim), aggregated before any shuffle.

    ``mask`` leaves rows out; ``least_variance`` bounds the variance from below before the root is taken.
    """
    df = df if mask is None else df.where(mask)
    if least_variance is not None:
        out = pool_embeddings(df, keys, vector)
        return out.withColumn("std", F.sqrt(F.greatest(F.col("std") * F.col("std"), F.lit(least_variance))))
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double")).groupBy(*keys, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"))


def _fragments(token: Column) -> Column:
    """The runs of a token's characters between blanks: their text, first and last place, in order."""
    marks = F.split(F.regexp_replace(token, r"(?U)\s", " "), "")
    edge = F.array(F.lit(" "))
    places = lambda beside: F.filter(F.transform(F.zip_with(marks, beside, lambda c, b: (c != " ") & (b == " ")), lambda yes, i: F.when(yes, i)), lambda i: i.isNotNull())
    firsts, lasts = places(F.concat(edge, marks)), places(F.concat(F.slice(marks, 2, F.greatest(F.size(marks), F.lit(1))), edge))
    return F.arrays_zip(F.regexp_extract_all(token, F.lit(r"((?U)\S+)"), 0).alias("text"), firsts.alias("first"), lasts.alias("last"))


def chars_to_words(df: DataFrame, keys: Sequence[str], pos: str, token: str, start: str, end: str) -> DataFrame:
    """Token times to word times: characters take even shares of their token, and runs between blanks make words.

    A token's characters stay together: what is shuffled is a row for each token, and a word is put together from the runs that its tokens have of it.
    """
    tokens = df.where(F.length(token) > 0).select(*keys, pos, token, start, end, F.length(token).alias("_n"), F.col(token).rlike(r"(?U)\S\z").alias("_open"), F.col(token).rlike(r"(?U)\A\S").alias("_joins"), F.size(F.regexp_extract_all(F.col(token), F.lit(r"((?U)\S+)"), 0)).alias("_runs"))
    small = fits(tokens, keys)
    tokens = scan(tokens, keys, [F.col(pos)], before={"_was": F.col("_open")}, small=small)
    tokens = tokens.withColumn("_on", F.col("_joins") & F.coalesce("_was", F.lit(False)))  # its first run goes on with the word before
    tokens = scan(tokens, keys, [F.col(pos)], sums={"_words": F.col("_runs") - F.col("_on").cast("int")}, small=small)
    span = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    at = lambda i: F.col(start) + span * i / F.col("_n")
    runs = tokens.select(*keys, pos, start, end, "_n", (F.col("_words") - F.col("_runs")).alias("_before"), F.posexplode(_fragments(F.col(token))).alias("_i", "_r"))
    runs = runs.select(*keys, pos, (F.col("_before") + F.col("_i")).cast("int").alias("word_index"), F.col("_r.text").alias("_text"), at(F.col("_r.first")).alias("_a"), at(F.col("_r.last") + 1).alias("_b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "_text"))), lambda s: s["_text"]), "")
    words = runs.groupBy(*keys, "word_index").agg(text.alias("word"), F.bround(F.min("_a"), 3).alias("start_seconds"), F.bround(F.max("_b"), 3).alias("end_seconds"))
    return words.select(*keys, "word", "start_seconds", "end_seconds", "word_index")


def even_words(df: DataFrame, keys: Sequence[str], text: str, seconds: str) -> DataFrame:
    """Words of a text with even shares of its duration."""
    parts = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    total = F.greatest(F.col(seconds), F.lit(0.01))
    return df.select(*keys, total.alias("_t"), F.size(parts).alias("_n"), F.posexplode(parts).alias("word_index", "word")).select(
        *keys, "word", (F.col("_t") * F.col("word_index") / F.col("_n")).alias("start_seconds"), (F.col("_t") * (F.col("word_index") + 1) / F.col("_n")).alias("end_seconds"), "word_index"
    )
