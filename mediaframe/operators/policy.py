"""Sensitive-media decisions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.functions.numbers import softmax_first


def classify(first: Column, second: Column, threshold: float | None, size: Column | int = 2) -> Column:
    """Logits [NSFW, SFW] to SENSITIVE or SAFE; QUARANTINED without exactly two finite ones or a threshold."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = (F.lit(size) if isinstance(size, int) else size) == 2
    p = softmax_first(first.cast("double"), second.cast("double"))
    return F.when(F.lit(threshold is None) | ~ok | ~finite(first) | ~finite(second), F.lit("QUARANTINED")).when(p >= F.lit(threshold), F.lit("SENSITIVE")).otherwise(F.lit("SAFE"))


def resolve_decision(media: DataFrame, manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """decision: the manual one of this revision, else the automatic one of this revision and epoch, else QUARANTINED."""
    m = manual.select("media_id", "content_revision", F.col("decision").alias("manual_decision"))
    a = automatic.select("media_id", "content_revision", "access_epoch", F.col("decision").alias("automatic_decision"))
    both = media.join(m, ["media_id", "content_revision"], "left").join(a, ["media_id", "content_revision", "access_epoch"], "left")
    return both.withColumn("decision", F.coalesce("manual_decision", "automatic_decision", F.lit("QUARANTINED"))).drop("manual_decision", "automatic_decision")


def build_exposure(media: DataFrame, manual: DataFrame, automatic: DataFrame) -> DataFrame:
    return resolve_decision(media, manual, automatic).select("media_id", "content_revision", F.col("decision").alias("exposure"))


def pending_screening(media: DataFrame, runs: DataFrame, pipeline: str) -> DataFrame:
    """Available rows without a raw result of their fence from this pipeline."""
    done = runs.where((F.col("status") == "RAW_RESULT") & (F.col("pipeline") == pipeline)).select("media_id", "content_revision", "access_epoch")
    return media.where("availability = 'AVAILABLE'").join(done, ["media_id", "content_revision", "access_epoch"], "left_anti")


def publish_current(results: DataFrame, media: DataFrame) -> DataFrame:
    """Classifier output of rows that are still the same and available; late output drops."""
    live = media.where("availability = 'AVAILABLE'").select("media_id", "content_revision", "access_epoch")
    return results.join(live, ["media_id", "content_revision", "access_epoch"], "left_semi")
