"""Epoch milliseconds of zone-less timestamps, whatever the session's time zone."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_millis(c: Column) -> Column:
    """Milliseconds of a timestamp_ntz since 1970-01-01 00:00 on the same wall clock."""
    c = c.cast("timestamp_ntz")
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(c).cast("bigint") * 3600 + F.minute(c) * 60
    return days * 86_400_000 + seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("bigint")


def zoned_millis(text: Column, tz: str) -> Column:
    """Text like 2017-01-27 18:42:00, unpadded fields allowed, on the wall clock of tz; null when it doesn't parse."""
    good = text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\s*$")
    wall = F.when(good, F.trim(text).try_cast("timestamp_ntz"))
    return wall_millis(F.convert_timezone(F.lit(tz), F.lit("UTC"), wall))


def bound_millis(bound: int | str, tz: str = "UTC") -> int:
    """A query bound: milliseconds as they are, or text like 2015-02-26 21:42:53 on the wall clock of tz."""
    if isinstance(bound, str):
        wall = datetime.strptime(bound.strip(), "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(tz))
        return int(wall.timestamp()) * 1000
    return bound
