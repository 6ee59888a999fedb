"""Timelines: period summaries, covers, samples, ranks and neighbours of visible media."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediaframe.functions.time import LEVELS
from mediaframe.plans.rank import asof_latest, ordered_rank


def newest_first() -> list[Column]:
    return [F.col("sort_at").desc_nulls_last(), F.col("media_id").desc()]


def oldest_first() -> list[Column]:
    return [F.col("sort_at").asc_nulls_first(), F.col("media_id").asc()]


def period_summary(v: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(level, key, items, newest) of every level in one pass over the rows."""
    keys = [f"{x}_key" for x in levels]
    out = v.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("items"), F.max("sort_at").alias("newest"))
    level = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(x)) for x, k in zip(levels, keys)])
    return out.select(level.alias("level"), F.coalesce(*keys).alias("key"), "items", "newest")


def feed_rank(v: DataFrame) -> DataFrame:
    """rank: rows strictly ahead in feed order (newest first, undated last)."""
    return ordered_rank(v, newest_first())


def day_position(v: DataFrame) -> DataFrame:
    """day_position and day_size: place among the rows of the day in feed order, and their number."""
    return ordered_rank(v, newest_first(), "day_position", [F.col("day_key")], "day_size")


def neighbours(v: DataFrame) -> DataFrame:
    """previous_id and next_id of every row in feed order."""
    ranked = feed_rank(v.select("media_id", "sort_at")).select("media_id", "rank")
    side = lambda name, step: ranked.select(F.col("media_id").alias(name), (F.col("rank") + step).alias("rank"))
    return ranked.join(side("previous_id", 1), "rank", "left").join(side("next_id", -1), "rank", "left").select("media_id", "rank", "previous_id", "next_id")


def covers(v: DataFrame, level: str, n: int = 3) -> DataFrame:
    """The newest n of each period, with their place."""
    w = Window.partitionBy(f"{level}_key").orderBy(*newest_first())
    return v.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select(F.col(f"{level}_key").alias("key"), "place", "media_id")


def samples(v: DataFrame, level: str) -> DataFrame:
    """Oldest, lower middle and newest of each period in the order of time; all of three or fewer."""
    key = F.col(f"{level}_key")
    at = ordered_rank(v.select(key.alias("key"), "sort_at", "media_id"), oldest_first(), "place", [F.col("key")], "size")
    chosen = (F.col("size") <= 3) | (F.col("place") == 0) | (F.col("place") == F.floor((F.col("size") - 1) / 2)) | (F.col("place") == F.col("size") - 1)
    return at.where(chosen).select("key", "place", "media_id")


def day_headers(v: DataFrame) -> DataFrame:
    """A header for each day, anchored at its first row in feed order."""
    return covers(v, "day", 1).select(F.col("key").alias("day_key"), F.col("media_id").alias("anchor_id"))


def timeline(v: DataFrame, level: str) -> DataFrame:
    """Entries of a level: photos with their day's header, or cards of periods with covers and samples' count."""
    if level == "photo":
        return day_position(v).select(F.col("day_key").alias("key"), "media_id", (F.col("day_position") == 0).alias("header"), F.col("day_size").alias("items"))
    head = covers(v, level, 1).select("key", F.col("media_id").alias("cover_id"))
    some = samples(v, level).groupBy("key").agg(F.count("*").alias("samples"))
    return period_summary(v, (level,)).drop("level").join(head, "key").join(some, "key")


def chunk(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Ordered chunks of a fixed size."""
    return ordered_rank(df, order).withColumn("chunk", F.floor(F.col("rank") / size).cast("long"))


def period_rank(v: DataFrame, level: str, anchors: DataFrame) -> DataFrame:
    """Of each anchor's period: how many periods are newer. Periods are few beside rows, and come summed up."""
    periods = period_summary(v, (level,)).select("key", "newest")
    ranked = periods.withColumn("newer", (F.rank().over(Window.orderBy(F.col("newest").desc_nulls_last())) - 1).cast("long"))
    return anchors.join(ranked.select("key", "newer"), "key")


def asof_row(anchors: DataFrame, v: DataFrame, at: str) -> DataFrame:
    """anchors with the media_id of the latest row at or before the instant `at`."""
    return asof_latest(anchors, v, at, "sort_at", "media_id")
