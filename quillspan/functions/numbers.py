"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient(c: Column, kind: str, default: float) -> Column:
    """A cast that gives ``default`` for what it cannot read."""
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def decibel(c: Column) -> Column:
    return 20 * F.log10(F.greatest(c, F.lit(1e-8)))


def _halves(x: Column) -> tuple[Column, Column]:
    """Veltkamp's split: two numbers of half the digits whose sum is ``x``."""
    high = x * 134217729.0 - (x * 134217729.0 - x)
    return high, x - high


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, the product not rounded: its rounding error and the sum's (Dekker's, Knuth's) are added last. Plain where the split overflows."""
    product, (ah, al), (bh, bl) = a * b, _halves(a), _halves(b)
    low = al * bl - (((product - ah * bh) - al * bh) - ah * bl)
    total = product + c
    part = total - product
    error = low + ((product - (total - part)) + (c - part))
    return F.when(F.isnan(error), total).otherwise(total + error)


def between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation as DuckDB's quantiles have it, to the last digit: low * (1 - share) fused with high * share."""
    return F.when(low == high, low).otherwise(fused(low.cast("double"), 1 - share, high.cast("double") * share))


def linear(db: Column) -> Column:
    """10^(dB/20); 0 for -100 dB or less, and for what is not finite."""
    bad = db.isNull() | F.isnan(db) | (db <= -100) | (db == float("inf"))
    return F.when(bad, 0.0).otherwise(F.pow(F.lit(10.0), db / 20))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def strength(pause_ms: Column, major: float = 400, minor: float = 150) -> Column:
    return F.when(pause_ms >= major, "major").when(pause_ms >= minor, "minor").otherwise("continuing")


def generation_budget(seconds: Column, per_second: float, floor: int, cap: int, margin: int) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.ceil(seconds * per_second) + margin)).cast("int")


def quality_score(text: Column, n_words: Column, seconds: Column, alignment: Column, energy_db: Column, rate: Column, pause_ms: Column) -> Column:
    """Weighted sum of clipped shares, less a small pause penalty; nulls count as zero, unknown energy as -60 dB."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        0.34 * (clamp(zero(n_words), 0.0, 24.0) / 24)
        + 0.18 * (clamp(zero(seconds), 0.0, 4.0) / 4)
        + 0.18 * clamp(zero(alignment), 0.0, 1.0)
        + 0.14 * clamp((F.coalesce(energy_db, F.lit(-60.0)) + 45) / 30, 0.0, 1.0)
        + 0.10 * clamp(1 - F.abs(zero(rate) - 3.6) / 4, 0.0, 1.0)
        + 0.06 * (clamp(F.length(F.coalesce(text, F.lit(""))).cast("double"), 0.0, 120.0) / 120)
        - 0.03 * (clamp(zero(pause_ms), 0.0, 800.0) / 800)
    )


def words_per_second(words: Column, seconds: Column) -> Column:
    """Half-even to three digits; a span counts for a hundredth of a second at least."""
    return F.bround(words / F.greatest(seconds, F.lit(0.01)), 3)


def kbps(bytes_: Column, seconds: Column) -> Column:
    return ratio(bytes_ * 8 / 1000, seconds)


def gigabytes(bytes_: Column) -> Column:
    return bytes_ / float(1024**3)
