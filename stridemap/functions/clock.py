"""Service times: seconds since midnight of the service day, which may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_service_time(value: Column) -> Column:
    """'HH:MM:SS' with any number of hours -> seconds; null if it isn't of that form."""
    part = lambda k: F.regexp_extract(value, r"^\s*(\d+):(\d+):(\d+)\s*$", k).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def parse_departure(value: Column, default: int = 8 * 3600) -> Column:
    """'HH:MM' of a form field -> seconds. An empty hour is 0, a missing text or minute the default's part."""
    parts = F.split(value, ":")
    number = lambda p: F.when(F.trim(p) == "", F.lit(0)).otherwise(F.trim(p).try_cast("int"))
    hours = F.when(value.isNull(), F.lit(default // 3600)).otherwise(number(F.get(parts, F.lit(0))))
    minutes = F.when(F.size(parts) >= 2, number(F.get(parts, F.lit(1)))).otherwise(F.lit(default % 3600 // 60))
    return hours * 3600 + minutes * 60


def format_clock(seconds: Column) -> Column:
    """Seconds -> 'HH:MM', hours past 24 allowed."""
    hours, minutes = F.floor(seconds / 3600).cast("string"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("string")
    pad = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    return F.concat(pad(hours), F.lit(":"), pad(minutes))


def whole_minutes(seconds: Column) -> Column:
    """A duration in minutes, rounded up, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(seconds / 60))
