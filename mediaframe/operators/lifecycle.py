"""Trash, retention and content-addressed ingest."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RETENTION_MS = 30 * 24 * 3600 * 1000


def _marked(media: DataFrame, ids: DataFrame) -> DataFrame:
    return media.join(ids.select("media_id").distinct().withColumn("_hit", F.lit(True)), "media_id", "left")


def trash(media: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Available imports with a file go to the trash at `now`."""
    hit = F.col("_hit") & (F.col("availability") == "AVAILABLE") & (F.col("source") != "DEVICE") & F.col("file").isNotNull()
    hit = F.coalesce(hit, F.lit(False))
    return _marked(media, ids).withColumns({"availability": F.when(hit, "TRASHED").otherwise(F.col("availability")), "trashed_at": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("trashed_at"))}).drop("_hit")


def restore(media: DataFrame, ids: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("_hit") & (F.col("availability") == "TRASHED") & (F.col("source") != "DEVICE"), F.lit(False))
    return _marked(media, ids).withColumns({"availability": F.when(hit, "AVAILABLE").otherwise(F.col("availability")), "trashed_at": F.when(~hit, F.col("trashed_at"))}).drop("_hit")


def expire(media: DataFrame, now: str) -> DataFrame:
    """Rows trashed 30 days ago or earlier become PURGING."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{RETENTION_MS // 1000}' SECOND")
    due = F.coalesce((F.col("availability") == "TRASHED") & (F.col("trashed_at") <= cutoff), F.lit(False))
    return media.withColumn("availability", F.when(due, "PURGING").otherwise(F.col("availability")))


def finish_purge(media: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the purged rows."""
    gone = media.where("availability = 'PURGING'").select("media_id")
    return {"media": media.where("availability <> 'PURGING' or availability is null")} | {k: df.join(gone, "media_id", "left_anti") for k, df in children.items()}


def ingest_batch(batch: DataFrame, media: DataFrame, max_bytes: int) -> DataFrame:
    """(seq, sha, outcome) of each row of a batch (seq, content, valid).

    EMPTY, TOO_LARGE and INVALID rows fail alone; of equal contents the first is added, or
    restored if a trashed item has it, and the others, like known contents, are duplicates.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    failure = F.when(size == 0, "EMPTY").when(size > max_bytes, "TOO_LARGE").when(~F.col("valid"), "INVALID")
    rows = batch.select("seq", failure.alias("failure"), F.when(failure.isNull(), F.sha2(F.col("content").cast("binary"), 256)).alias("sha"))
    first = rows.where("sha is not null").groupBy(F.col("sha").alias("of")).agg(F.min("seq").alias("first"))  # failed rows have no digest and meet nobody
    known = media.groupBy("sha").agg(F.max(F.when(F.col("availability") == "TRASHED", 1).otherwise(0)).alias("trashed"))
    joined = rows.join(first, F.col("sha") == F.col("of"), "left").join(known, "sha", "left")
    outcome = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("seq") > F.col("first"), "duplicate").when(F.col("trashed") == 1, "restored").when(F.col("trashed") == 0, "duplicate").otherwise("added")
    return joined.select("seq", "sha", outcome.alias("outcome"))


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """One row: added, duplicates, failed, restored and the distinct kinds of failure."""
    bad = ["EMPTY", "TOO_LARGE", "INVALID"]
    is_ = lambda v: F.count_if(F.col("outcome") == v)
    return outcomes.agg(is_("added").alias("added"), is_("duplicate").alias("duplicates"), F.count_if(F.col("outcome").isin(bad)).alias("failed"), is_("restored").alias("restored"),
                        F.array_join(F.array_sort(F.collect_set(F.when(F.col("outcome").isin(bad), F.col("outcome")))), ",").alias("kinds"))
