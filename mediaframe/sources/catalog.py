"""Incremental scans of a provider's rows, file inventories, and table sinks."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from mediaframe.sources.pointers import Pointers

MOST_VOLUMES = 200


def normalize_raw(raw: DataFrame) -> DataFrame:
    """Provider row to catalogue types: numbers at or under zero and empty times are null.

    `raw` has id, volume, generation_added, generation_modified, taken_ms, added_s, size.
    """
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    taken, added = F.timestamp_millis(positive("taken_ms")), F.timestamp_seconds(positive("added_s"))
    source = F.when(taken.isNotNull(), "TAKEN").when(added.isNotNull(), "ADDED").otherwise("UNKNOWN")
    return raw.withColumns({"taken_at": taken, "added_at": added, "date_source": source, "size": F.when(F.col("size") >= 0, F.col("size"))}).drop("taken_ms", "added_s")


def resolve_checkpoint(states: DataFrame, checkpoints: DataFrame, full_access: bool) -> DataFrame:
    """(volume, version, generation, start): the stored generation only if the version is the same,
    it is not beyond the current one, and both runs saw everything; else 0."""
    c = checkpoints.select("volume", F.col("version").alias("v0"), F.col("generation").alias("g0"), F.col("full_access").alias("f0"))
    usable = (F.col("version") == F.col("v0")) & (F.col("g0") <= F.col("generation")) & F.col("f0") & F.lit(full_access)
    return states.join(c, "volume", "left").select("volume", "version", "generation", F.when(usable, F.col("g0")).otherwise(0).cast("long").alias("start"))


def scan_changed(raw: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Rows changed after their volume's start; the checkpoint has one row a volume.

    Volumes are few (a device's storage), so their starts come to the driver and go into the filter
    as literals, which reaches the scan; beyond `MOST_VOLUMES` they are joined.
    """
    starts = checkpoint.select("volume", "start").limit(MOST_VOLUMES + 1).collect()
    if len(starts) > MOST_VOLUMES:
        return raw.join(checkpoint.select("volume", "start"), "volume").where("generation_modified > start").drop("start")
    later = [(F.col("volume") == r.volume) & (F.col("generation_modified") > r.start) for r in starts]
    return raw.where(reduce(lambda a, b: a | b, later, F.lit(False)))


def visible_ids(raw: DataFrame) -> DataFrame:
    return raw.select("volume", "id", "generation_added")


def reconcile_detached(media: DataFrame, volumes: DataFrame) -> DataFrame:
    """Device rows of volumes that are no longer listed become INACCESSIBLE."""
    here = volumes.select(F.col("volume").alias("volume_name")).distinct().withColumn("_here", F.lit(True))
    gone = (F.col("source") == "DEVICE") & F.col("_here").isNull() & (F.col("availability") == "AVAILABLE")
    return media.join(here, "volume_name", "left").withColumn("availability", F.when(gone, "INACCESSIBLE").otherwise(F.col("availability"))).drop("_here")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(sha, size, modified_at) of files named by 64 hexadecimal digits and .image; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.image").load(path).select("path", "length", "modificationTime")
    named = files.withColumn("sha", F.regexp_extract("path", r"/([0-9a-f]{64})\.image$", 1))
    return named.where("sha <> ''").select("sha", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti"))


def published(spark: SparkSession, path: str) -> Row | None:
    """The last pointer (seq, generation) of what is published at `path`; None if nothing is."""
    seq, pointer = Pointers(spark, f"{path}/_pointer").last()
    return Row(seq=seq, generation=pointer["generation"]) if seq else None


def publish(df: DataFrame, path: str, generation_id: str, keep: int | None = None, attempts: int = 3) -> None:
    """Writes a generation to a fresh folder, then adds a pointer to it; readers follow the last pointer.

    Nothing that a reader may hold is overwritten: a job that fails half way, or runs again, leaves
    the last pointer and its folder as they are. Other writers' pointers only come before or after this one.
    Folders of all but the last `keep` generations are removed afterwards (None: none are).
    """
    spark, pointers = df.sparkSession, Pointers(df.sparkSession, f"{path}/_pointer")
    name = f"{generation_id}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/generation={name}")
    if not any(pointers.advance(max(pointers.numbers(), default=0), {"generation": name}) for _ in range(attempts)):
        raise RuntimeError(f"{attempts} other generations were published meanwhile")
    if keep:
        for number in pointers.numbers()[:-keep]:
            pointers.remove(f"{path}/generation={pointers.read(number)['generation']}")
        pointers.trim(keep)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The generation that the last pointer names; a reader keeps it though others are published."""
    last = published(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/generation={last.generation}")


def export_selection(ids: DataFrame, media: DataFrame, exposure: DataFrame) -> DataFrame:
    """Of the selected ids the visible rows that may be exported."""
    from mediaframe.operators.fence import allows, visible

    v = visible(media, exposure)
    return v.where(allows(v, "EXPORT")).join(ids.select("media_id").distinct(), "media_id", "left_semi")


def retain_available(selection: DataFrame, v: DataFrame) -> DataFrame:
    return selection.select("media_id").intersect(v.select("media_id"))


def distinct_inputs(df: DataFrame) -> DataFrame:
    return df.distinct()


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b, equal."""
    only = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias(n)).withColumn("_k", F.lit(1))
    return only(a, b, "only_a").join(only(b, a, "only_b"), "_k").select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))
