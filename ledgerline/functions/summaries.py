"""Log-linear histogram buckets and aligned windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of each window length, and its offset from the epoch (weeks start on Monday). Fixed values.
WINDOWS = {"minute": (60_000, 0), "hour": (3_600_000, 0), "day": (86_400_000, 0), "week": (604_800_000, 345_600_000)}


def bucket_index(v: Column) -> Column:
    """Bucket of a value from 0: below 32 the value, then 32 buckets to each doubling."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 32, v.cast("int")).otherwise(((shift + 1) * 32 + F.call_function("shiftright", v, shift) - 32).cast("int"))


def bucket_low(i: Column) -> Column:
    g = F.floor(i / 32).cast("int")
    return F.when(i < 32, i.cast("long")).otherwise((F.lit(32) + i % 32).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(g - 1, F.lit(0))))


def bucket_high(i: Column) -> Column:
    g = F.floor(i / 32).cast("int")
    return bucket_low(i) + F.when(i < 32, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(g - 1, F.lit(0))) - 1)


def window_start(ms: Column, length: str) -> Column:
    """Start of the aligned window that holds an instant; null before the first week."""
    size, offset = WINDOWS[length]
    return F.when(ms >= offset, ms - F.pmod(ms - offset, F.lit(size)))


def time_bucket(ms: Column) -> Column:
    """Two-second bucket."""
    return ((ms - F.pmod(ms, F.lit(2000))) / 2000).cast("long")
