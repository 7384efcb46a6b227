"""Date and time expressions over ISO-8601 strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """The date in the stated offset; else the first ten characters; else ``unknown-date``."""
    text = F.coalesce(c, F.lit(""))
    parsed = F.try_to_timestamp(text)
    return F.when(parsed.isNotNull() & text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).when(F.length(text) >= 10, F.substring(text, 1, 10)).otherwise("unknown-date")


def iso_timestamp(c: Column) -> Column:
    """The instant; without an offset it is UTC; what cannot be read comes before all else."""
    return F.coalesce(F.try_to_timestamp(c), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def path_stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def iso_now(micros: bool = False) -> Column:
    """The current instant as an ISO string in UTC, to the second or the microsecond."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if micros else "") + "'+00:00'")
