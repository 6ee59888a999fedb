"""Instants, period keys and capture dates. Instants are UTC; a library zone is named explicitly."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNDATED = "undated"
LEVELS = ("day", "week", "month", "year")


def effective_at(taken: Column, added: Column) -> Column:
    return F.coalesce(taken, added)


def local(instant: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz"))


def period_keys(instant: Column, zone: str = "UTC", week_start: int = 0) -> dict[str, Column]:
    """Keys by level in the library zone; weeks begin `week_start` days after Monday; no instant is 'undated'."""
    here = local(instant, zone)
    monday = F.date_add(F.date_trunc("week", F.date_sub(here.cast("date"), week_start).cast("timestamp")).cast("date"), week_start)
    keys = {"day": F.date_format(here, "yyyy-MM-dd"), "week": F.date_format(monday, "yyyy-MM-dd"), "month": F.date_format(here, "yyyy-MM"), "year": F.date_format(here, "yyyy")}
    return {k: F.coalesce(v, F.lit(UNDATED)) for k, v in keys.items()}


def with_periods(media: DataFrame, zone: str = "UTC", week_start: int = 0) -> DataFrame:
    """Adds sort_at and day_key, week_key, month_key, year_key."""
    dated = media.withColumn("sort_at", effective_at(F.col("taken_at"), F.col("added_at")))
    return dated.withColumns({f"{k}_key": v for k, v in period_keys(F.col("sort_at"), zone, week_start).items()})


def exif_instant(text: Column, offset: Column, zone: str) -> Column:
    """Capture text 'yyyy:MM:dd HH:mm:ss' with an optional ±HH:mm offset; else the library zone. Malformed: null.

    Of a local time that a clock change repeats, the zone gives the earlier instant.
    """
    well_formed = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    wall = F.try_to_timestamp(F.when(well_formed, text), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    seconds = F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), sign * (F.substring(offset, 2, 2).cast("int") * 3600 + F.substring(offset, 5, 2).cast("int") * 60))
    by_offset = F.timestamp_seconds(F.unix_timestamp(wall.cast("timestamp")) - seconds)
    return F.when(seconds.isNotNull(), by_offset).otherwise(F.to_utc_timestamp(wall.cast("timestamp"), zone))


def in_date_range(instant: Column, start: str | None, until: str | None) -> Column:
    """Half-open [start, until); rows without an instant pass only where neither bound is set."""
    if start is not None and until is not None and start >= until:
        raise ValueError("the range is empty")
    out = F.lit(True)
    if start is not None:
        out = out & (instant >= F.lit(start).cast("timestamp_ntz"))
    if until is not None:
        out = out & (instant < F.lit(until).cast("timestamp_ntz"))
    return F.coalesce(out, F.lit(False))


def end_of_day(day: Column, zone: str) -> Column:
    """First instant after a local day."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
