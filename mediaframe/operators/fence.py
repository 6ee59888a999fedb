"""Who may see a row, and whether a derived row still speaks of it.

A derived row counts only while (media_id, content_revision, access_epoch) equals the live row's,
the row is available and not trashed, and an exposure of the same revision says SAFE.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FENCE = ["media_id", "content_revision", "access_epoch"]


def with_exposure(media: DataFrame, exposure: DataFrame) -> DataFrame:
    """Media with the exposure of their own revision; none: null."""
    return media.join(exposure.select("media_id", "content_revision", "exposure"), ["media_id", "content_revision"], "left")


def visible(media: DataFrame, exposure: DataFrame, include_protected: bool = False) -> DataFrame:
    """Available rows that are SAFE, or all available ones; a missing exposure hides."""
    live = media.where("availability = 'AVAILABLE'")
    return live if include_protected else live.join(exposure.where("exposure = 'SAFE'").select("media_id", "content_revision"), ["media_id", "content_revision"], "left_semi")


def eligible(media: DataFrame, exposure: DataFrame) -> DataFrame:
    return visible(media.where("trashed_at is null"), exposure)


def current(derived: DataFrame, live: DataFrame) -> DataFrame:
    """Derived rows whose fence equals that of a live row."""
    return derived.join(live.select(*FENCE), FENCE, "left_semi")


def stale(derived: DataFrame, live: DataFrame) -> DataFrame:
    """Derived rows whose media is gone, unavailable, trashed, revised, granted anew or not SAFE."""
    return derived.join(live.select(*FENCE), FENCE, "left_anti")


def pending(live: DataFrame, derived: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Live rows without a derived row of their fence; a failure of the same fence is not tried again."""
    out = live.join(derived.select(*FENCE), FENCE, "left_anti")
    return out if failures is None else out.join(failures.select(*FENCE), FENCE, "left_anti")


def allows(media: DataFrame, operation: str) -> Column:
    """Whether an available row supports ORGANIZE, SHARE, EXPORT or DELETE."""
    has_file = (F.col("source") == "DEVICE") & F.col("uri").isNotNull() | (F.col("source") != "DEVICE") & F.col("file").isNotNull()
    may = {"ORGANIZE": F.lit(True), "SHARE": has_file, "EXPORT": has_file, "DELETE": (F.col("source") != "DEVICE") & F.col("file").isNotNull()}[operation]
    return (F.col("availability") == "AVAILABLE") & may


def comparison_capabilities(media: DataFrame) -> DataFrame:
    """can_compare: SAFE, available, not trashed; can_trash: that, and an import with a file."""
    compare = (F.col("exposure") == "SAFE") & (F.col("availability") == "AVAILABLE") & F.col("trashed_at").isNull()
    compare = F.coalesce(compare, F.lit(False))
    return media.withColumn("can_compare", compare).withColumn("can_trash", compare & (F.col("source") != "DEVICE") & F.col("file").isNotNull())


def progress(live: DataFrame, derived: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: eligible, completed, failed, complete."""
    mark = lambda df, name: df.select(*FENCE).distinct().withColumn(name, F.lit(1))
    all_ = live.select(*FENCE).join(mark(derived, "d"), FENCE, "left").join(mark(failures, "f"), FENCE, "left")
    counts = all_.agg(F.count("*").alias("eligible"), F.count("d").alias("completed"), F.count("f").alias("failed"))
    return counts.withColumn("complete", (F.col("eligible") == F.col("completed")) & (F.col("failed") == 0))


def coverage(live: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """One row: eligible media, and of each feature the media with a current row."""
    out = live.select(*FENCE)
    for name, df in runs.items():
        out = out.join(df.select(*FENCE).distinct().withColumn(name, F.lit(1)), FENCE, "left")
    return out.agg(F.count_distinct("media_id").alias("eligible"), *[F.count_distinct(F.when(F.col(n) == 1, F.col("media_id"))).alias(n) for n in runs])


def ocr_coverage(live: DataFrame, results: DataFrame) -> DataFrame:
    """One row: eligible media, and those with a current recognised text."""
    return coverage(live, {"indexed": results})


def status_counts(media: DataFrame, exposure: DataFrame) -> DataFrame:
    """One row: available, and of them quarantined (no exposure, or one that is not SAFE)."""
    live = with_exposure(media.where("availability = 'AVAILABLE'"), exposure)
    return live.agg(F.count("*").alias("available"), F.count_if(F.coalesce(F.col("exposure") != "SAFE", F.lit(True))).alias("quarantined"))


def may_access(resolved: DataFrame, revealed: bool) -> Column:
    """SAFE rows, or any while a reveal lease holds; the decision must be of the live revision."""
    return F.coalesce((F.lit(revealed) | (F.col("decision") == "SAFE")) & (F.col("availability") == "AVAILABLE") & F.col("trashed_at").isNull() & (F.col("asked_revision") == F.col("content_revision")), F.lit(False))
