"""Time of day and weekday of naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of_day(ts: Column) -> Column:
    """Seconds since midnight, microseconds included."""
    second = F.extract(F.lit("SECOND"), ts).cast("double")
    return F.hour(ts) * 3600e0 + F.minute(ts) * 60e0 + second


def label(seconds: Column) -> Column:
    """HH:MM, cut to the minute; hours may pass 24."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"))


def weekday(ts: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive timestamp, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.lit("UTC")))
