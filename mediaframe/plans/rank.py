"""Ranks, neighbours and as-of look-ups without a window over all rows in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediaframe.plans.lineage import cut_lineage


def hour_of(instant: Column) -> Column:
    """Bucket of an instant; null (undated) stays null."""
    return F.floor(F.unix_timestamp(instant.cast("timestamp")) / 3600).cast("long")


def ordered_rank(df: DataFrame, order: list[Column], name: str = "rank", group: list[Column] | None = None, size: str | None = None) -> DataFrame:
    """Zero-based place of every row in `order`; with `group`, inside its group, whose row count goes to `size`.

    Rows are dealt by range over group and order together and numbered inside their partition; what
    lies before is a running sum over the counts of (partition, group). So one crowded group, such as
    the undated rows or a year that holds everything, is cut by the order itself and never gathers in
    one task. `order` should end in a key without many equals: rows equal in all of it stay together.
    Range boundaries come from Spark's sample, so `df` is read twice; the counts are exact, and the
    dealt rows are checkpointed, so that they stay where they were counted.
    """
    named = [f"_g{i}" for i in range(len(group or []))]
    by = [F.col(c).asc_nulls_first() for c in named]
    dealt = df.withColumns(dict(zip(named, group or []))).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = cut_lineage(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.expr("shiftright(_id, 33)")))
    counts = placed.groupBy("_part", *named).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    whole = Window.partitionBy(*named)  # of a group there is one row a partition
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frame = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"{c}_") for c in named], "_first", before.alias("_before"), F.sum("_n").over(whole).alias("_size"))
    same = F.col("_part") == F.col("_p")
    for c in named:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    joined = placed.join(frame if named else F.broadcast(frame), same)  # without groups one row a partition
    columns = {name: F.col("_id") - F.col("_first") + F.col("_before")} | ({size: F.col("_size")} if size else {})
    return joined.select(*df.columns, *[v.cast("long").alias(k) for k, v in columns.items()])


def asof_latest(anchors: DataFrame, rows: DataFrame, at: str, order: str, value: str) -> DataFrame:
    """anchors with `value` of the latest row whose `order` is at or before `at` (ties: the largest value).

    Anchors and rows meet in hour buckets, where a running maximum answers; an anchor without an
    earlier row in its hour takes the last row of the latest hour before, from the small frame of hours.
    """
    r = rows.where(F.col(order).isNotNull()).select(hour_of(F.col(order)).alias("_h"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_kind"))
    a = anchors.withColumn("_h", hour_of(F.col(at)))
    keys = [c for c in anchors.columns]
    points = a.select("_h", F.struct(*keys).alias("_a"), F.col(at).alias("_at"))
    union = r.select("_h", F.col("_r.o").alias("_at"), "_kind", "_r", F.lit(None).cast(points.schema["_a"].dataType).alias("_a")).unionByName(
        points.select("_h", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_a"))
    w = Window.partitionBy("_h").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = union.withColumn("_best", F.max("_r").over(w)).where("_kind = 1")
    hours = r.groupBy("_h").agg(F.max("_r").alias("_last")).unionByName(points.select("_h").distinct().withColumn("_last", F.lit(None).cast(r.schema["_r"].dataType))).groupBy("_h").agg(F.max("_last").alias("_last"))
    earlier = hours.withColumn("_prev", F.last("_last", ignorenulls=True).over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))).select("_h", "_prev")
    return inside.join(F.broadcast(earlier), "_h", "left").select("_a.*", F.coalesce("_best.v", "_prev.v").alias(value))
