"""Boundary metrics and prosody labels, composed of islands, matches, runs and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import numbers as N
from quillspan.operators import sequential
from quillspan.operators import signal as G


def boundary_metrics(frames: DataFrame, refs: DataFrame, keys: Sequence[str], pos: str, value: str, thresholds: Sequence[float], tolerance: int) -> DataFrame:
    """A row for each threshold: reference, predicted and matched boundaries, precision, recall and F1.

    ``frames`` (keys..., pos, value) give the predicted ones, a run's first largest value at or above the threshold; ``refs`` (keys..., pos). A
    reference takes the nearest free prediction within ``tolerance`` positions. Thresholds are few: frames are repeated for each that they reach.
    """
    steps = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    by = ["threshold", *keys]
    reached = frames.withColumn("threshold", F.explode(F.filter(steps, lambda t: F.col(value) >= t)))
    peaks = G.island_peaks(reached, by, pos, value, float("-inf")).select(*by, F.col(pos).cast("long").alias("pos"), F.lit(False).alias("is_ref"))
    marks = refs.withColumn("threshold", F.explode(steps)).select(*by, F.col(pos).cast("long").alias("pos"), F.lit(True).alias("is_ref"))
    events = peaks.unionByName(marks)
    counts = events.groupBy("threshold").agg(F.count_if("is_ref").alias("reference_boundaries"), F.count_if(~F.col("is_ref")).alias("predicted_boundaries"))
    hits = sequential.match_events(events, by, tolerance).groupBy("threshold").agg(F.count("*").alias("matched_boundaries"))
    out = counts.join(hits, "threshold", "left").na.fill(0, ["matched_boundaries"])
    out = out.withColumn("precision", N.ratio(F.col("matched_boundaries"), F.col("predicted_boundaries"))).withColumn("recall", N.ratio(F.col("matched_boundaries"), F.col("reference_boundaries")))
    return out.withColumn("f1", N.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def unit_energy(frames: DataFrame, units: DataFrame, key: str, width: float = 4.0) -> DataFrame:
    """(key, unit_no, energy): the mean rms of the frames within each unit; units without frames have no row."""
    inside = G.within_spans(units.select(key, "unit_no", "start_seconds", "end_seconds"), frames, [key], "start_seconds", "end_seconds", "t", width)
    return inside.groupBy(key, "unit_no").agg(F.avg("rms").alias("energy"))


def prosody(frames: DataFrame, units: DataFrame, key: str, reach: float = 0.8) -> DataFrame:
    """Labels of each unit: its length, words, speech rate, energy, the silence before and after it, and its strength.

    ``frames`` (key, t, rms), ``units`` (key, unit_no, start_seconds, end_seconds, start_word_index, end_word_index_exclusive). The silence
    threshold comes from all frames of a key; a unit without frames has the mean energy of its key.
    """
    stats = G.silence_stats(frames, [key], "rms").select(key, "threshold", "mean_rms")
    loud = frames.join(stats.select(key, "threshold"), key).select(key, "t", (F.col("rms") > F.col("threshold")).cast("double").alias("rms"))
    ends = {side: G.silence_around(loud, units.select(key, F.col("unit_no").alias("boundary_id"), F.col(at).alias("at")), key, 0.5, reach).select(key, F.col("boundary_id").alias("unit_no"), f"pause_{side}_ms") for side, at in (("before", "start_seconds"), ("after", "end_seconds"))}
    out = units.join(stats, key, "left").join(unit_energy(frames, units, key), [key, "unit_no"], "left")
    for side in ends.values():
        out = out.join(side, [key, "unit_no"], "left")
    seconds = F.greatest(F.col("end_seconds") - F.col("start_seconds"), F.lit(0.01))
    words = F.greatest(F.lit(0), F.col("end_word_index_exclusive") - F.col("start_word_index"))
    return out.select(
        key, "unit_no", F.bround(seconds, 3).alias("unit_seconds"), words.alias("word_count"), F.bround(words / seconds, 3).alias("speech_rate_wps"),
        F.bround(N.decibel(F.coalesce("energy", "mean_rms", F.lit(0.0))), 2).alias("mean_energy_db"), "pause_before_ms", "pause_after_ms", N.strength(F.col("pause_after_ms")).alias("strength"),
    )
