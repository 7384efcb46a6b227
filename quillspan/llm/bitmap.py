"""A filter of fixed size that thins out wide rows before a join, in DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 8 MB are broadcast whatever the input. With very many keys it lets more rows pass; none is lost.
FILTER_BITS = 1 << 26


def _bit(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(FILTER_BITS)) + 1


def _maps(some: DataFrame, hashed: Column) -> DataFrame:
    bits = some.select(_bit(hashed).alias("b"))
    return bits.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bitmap"))


def collected_bits(some: DataFrame, hashed: Column) -> np.ndarray:
    """The bitmap of ``some`` as bytes, for a scan in Python: bit h mod FILTER_BITS is in byte (h mod FILTER_BITS) >> 3, lowest first."""
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bitmap in _maps(some, hashed).collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        part = np.frombuffer(bytes(bitmap), np.uint8)
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = part
    return out


def maybe_in(rows: DataFrame, hashed: Column, some: DataFrame, some_hashed: Column) -> DataFrame:
    """The rows whose hash may be among those of ``some``: a broadcast bitmap, which never loses a row."""
    maps = _maps(some, some_hashed)
    numbered = rows.withColumn("_b", _bit(hashed)).withColumn("_p", F.bitmap_bit_position("_b")).withColumn("_bucket", F.bitmap_bucket_number("_b"))
    joined = numbered.join(F.broadcast(maps), F.col("_bucket") == F.col("bucket"))  # at most FILTER_BITS / 32768 rows of 4 KB
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("_p") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("_p", F.lit(8)))), F.lit(2)) == 1
    return joined.where(set_bit).drop("_b", "_p", "_bucket", "bucket", "bitmap")
