"""Calendar logic over unix seconds; days and hours are the session time zone's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: str | Column) -> Column:
    """Seconds, as a double, of a timestamp with or without a zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1e6


def day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def day_bounds(iso: str) -> tuple[Column, Column]:
    """Local midnight of a day and of the next one, which need not be 24 hours later."""
    d = F.lit(iso).cast("date")
    return F.unix_timestamp(d.cast("timestamp")).cast("double"), F.unix_timestamp(F.date_add(d, 1).cast("timestamp")).cast("double")


def overlaps_day(start: Column, end: Column, iso: str) -> Column:
    lo, hi = day_bounds(iso)
    return (end > lo) & (start < hi)


def within_day(ts: Column, iso: str) -> Column:
    lo, hi = day_bounds(iso)
    return (ts >= lo) & (ts < hi)


def in_band(seconds: Column, start: int, end: int) -> Column:
    """Whether the hour is in ``[start, end)``; the band wraps midnight when it doesn't end after it starts."""
    h = F.hour(F.timestamp_seconds(seconds))
    return (h >= start) & (h < end) if start < end else (h >= start) | (h < end)


def clock(seconds: Column, dated: bool = False) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "EEE dd MMM, HH:mm:ss" if dated else "HH:mm:ss")


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def clip_bounds(at: Column, seconds: Column, lead_in: float = 2.0, least: float = 1.0, most: float = 60.0) -> Column:
    """``start, end`` of a clip around an instant: ``lead_in`` before it, not before 0; its length within ``least`` and ``most``."""
    start = F.greatest(F.lit(0.0), at - lead_in)
    return F.struct(start.alias("start"), (start + F.greatest(F.lit(least), F.least(seconds, F.lit(most)))).alias("end"))


def clean_rate(numerator: Column, denominator: Column) -> Column:
    """``num, den`` of a frame rate that encoders take: as it is in lowest terms up to a denominator of 1001, else to
    a thousandth; 30/1 for none, or one outside 1..240."""
    a, b = numerator.cast("long"), denominator.cast("long")
    # Euclid's steps: no more than 92 for numbers of 64 bits
    pair = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % p["y"]).alias("y"))))["x"]
    value = F.try_divide(a.cast("double"), b.cast("double"))
    sign = F.when(b < 0, -1).otherwise(1)
    num, den = F.floor(a * sign / g).cast("long"), F.floor(F.abs(b) / g).cast("long")
    milli = F.bround(value * 1000).cast("long")
    m = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.struct(milli.alias("x"), F.lit(1000).cast("long").alias("y")), lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % p["y"]).alias("y"))))["x"]
    part = lambda x, y: F.struct(x.cast("long").alias("num"), y.cast("long").alias("den"))
    kept = F.when(den <= 1001, part(num, den)).otherwise(part(F.floor(milli / m), F.floor(F.lit(1000) / m)))
    return F.when(value.between(1.0, 240.0), kept).otherwise(part(F.lit(30), F.lit(1)))
