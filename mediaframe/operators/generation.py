"""Catalogue maintenance and generation-versioned derived tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediaframe.functions.time import with_periods
from mediaframe.operators.fence import current
from mediaframe.plans.rank import ordered_rank


def reconcile_scan(old: DataFrame, incoming: DataFrame, zone: str = "UTC") -> DataFrame:
    """The catalogue after a scan. Both have media_id, content_revision, availability, access_epoch,
    taken_at, added_at, exif_taken_at.

    Capture dates read from a file stay while the revision does, and win over the provider's; the
    access epoch goes up by one for a row that was not AVAILABLE; periods are computed anew.
    """
    names = ["content_revision", "availability", "access_epoch", "taken_at", "added_at", "exif_taken_at"]
    o = old.select("media_id", *[F.col(c).alias(f"o_{c}") for c in names])
    n = incoming.select("media_id", *[F.col(c).alias(f"n_{c}") for c in names if c not in ("availability", "access_epoch")], F.lit(True).alias("_new"))
    both = o.join(n, "media_id", "full_outer")
    seen, same = F.col("_new").isNotNull(), F.col("o_content_revision").eqNullSafe(F.col("n_content_revision"))
    exif = F.when(same, F.col("o_exif_taken_at")).otherwise(F.col("n_exif_taken_at"))
    back = seen & F.col("o_availability").isNotNull() & (F.col("o_availability") != "AVAILABLE")
    out = both.select("media_id",
        F.when(seen, F.col("n_content_revision")).otherwise(F.col("o_content_revision")).alias("content_revision"),
        F.when(seen, F.lit("AVAILABLE")).otherwise(F.col("o_availability")).alias("availability"),
        (F.coalesce("o_access_epoch", F.lit(1)) + back.cast("int")).cast("long").alias("access_epoch"),
        F.when(seen, F.coalesce(exif, "n_taken_at")).otherwise(F.col("o_taken_at")).alias("taken_at"),
        F.when(seen, F.col("n_added_at")).otherwise(F.col("o_added_at")).alias("added_at"),
        F.when(seen, exif).otherwise(F.col("o_exif_taken_at")).alias("exif_taken_at"))
    return with_periods(out, zone)


def mark_absent(media: DataFrame, seen: DataFrame, volumes: DataFrame, full_access: bool) -> DataFrame:
    """Available device rows that a scan did not see: MISSING if their volume kept its version and
    access was full, else INACCESSIBLE. `volumes` has volume_name and same_version."""
    s = seen.select("media_id").distinct().withColumn("_seen", F.lit(True))
    joined = media.join(s, "media_id", "left").join(volumes.select("volume_name", "same_version"), "volume_name", "left")
    absent = (F.col("source") == "DEVICE") & (F.col("availability") == "AVAILABLE") & F.col("_seen").isNull()
    kind = F.when(F.coalesce("same_version", F.lit(False)) & F.lit(full_access), "MISSING").otherwise("INACCESSIBLE")
    return joined.withColumn("availability", F.when(absent, kind).otherwise(F.col("availability"))).drop("_seen", "same_version")


def stable(start: DataFrame, end: DataFrame) -> DataFrame:
    """One row: whether no volume's version or generation moved during a scan; if one did, the batch is discarded."""
    s, e = (df.select("volume", F.struct("version", "generation").alias(n)) for df, n in ((start, "s"), (end, "e")))
    moved = s.join(e, "volume", "full_outer").agg(F.count_if(~F.col("s").eqNullSafe(F.col("e"))).alias("moved"))
    return moved.withColumn("stable", F.col("moved") == 0)


def reconcile_imports(media: DataFrame, inventory: DataFrame, zone: str = "UTC") -> DataFrame:
    """The catalogue after a look at the import files present: `inventory` has media_id, file_revision, file_size, modified_at.

    New files are inserted as available imports dated by their modification. A file of another revision or
    size loses what was read from it: a capture date that came from the file goes, others stay. Seen
    imports are AVAILABLE, and one that was not gets the next access epoch, so that what was derived
    before does not count again; unseen ones are MISSING. Trashed and purging imports and device rows
    stay as they are. Periods are computed anew. `media` has source, availability, content_revision,
    access_epoch, size, taken_at, added_at, date_source; further columns of a new row are null.
    """
    inv = inventory.select(F.col("media_id").alias("_id"), "file_revision", "file_size", "modified_at", F.lit(True).alias("_seen"))
    both = media.join(inv, F.col("media_id") == F.col("_id"), "full_outer")
    new, seen = F.col("media_id").isNull(), F.col("_seen").isNotNull()
    open_ = (F.col("source") != "DEVICE") & ~F.col("availability").isin("TRASHED", "PURGING")
    back = open_ & seen & (F.col("availability") != "AVAILABLE")
    changed = open_ & seen & ~(F.col("file_revision").eqNullSafe(F.col("content_revision")) & F.col("file_size").eqNullSafe(F.col("size")))
    read = changed & (F.col("date_source") == "EXIF")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    values = {
        "media_id": F.coalesce("media_id", "_id"),
        "source": F.when(new, "GOOGLE_IMPORT").otherwise(F.col("source")),
        "availability": F.when(new | is_(open_ & seen), "AVAILABLE").when(is_(open_), "MISSING").otherwise(F.col("availability")),
        "access_epoch": F.when(new, 1).otherwise(F.col("access_epoch") + is_(back).cast("int")).cast("long"),
        "content_revision": F.when(new | is_(changed), F.col("file_revision")).otherwise(F.col("content_revision")),
        "size": F.when(new | is_(changed), F.col("file_size")).otherwise(F.col("size")),
        "taken_at": F.when(~is_(read), F.col("taken_at")),
        "added_at": F.when(new, F.col("modified_at")).otherwise(F.col("added_at")),
        "date_source": F.when(new, F.when(F.col("modified_at").isNull(), "UNKNOWN").otherwise("FILE_MODIFIED")).when(is_(read), "FILE_MODIFIED").otherwise(F.col("date_source")),
    }
    return with_periods(both.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in media.columns]), zone)


def apply_exif(media: DataFrame, exif: DataFrame) -> DataFrame:
    """Dates read from files, where they were read from this revision."""
    e = exif.select("media_id", "content_revision", F.col("exif_taken_at").alias("_e"))
    return media.join(e, ["media_id", "content_revision"], "left").withColumn("taken_at", F.coalesce("_e", "taken_at")).drop("_e")


def copy_forward(source: DataFrame, live: DataFrame, target_id: str) -> DataFrame:
    """Rows of an earlier generation that still hold, as rows of a new one."""
    return current(source, live).withColumn("generation_id", F.lit(target_id))


def can_complete(progress: DataFrame, stored: int) -> DataFrame:
    return progress.withColumn("complete", (F.col("eligible") == F.col("completed")) & (F.col("completed") == stored) & (F.col("failed") == 0))


def replace_media_rows(base: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """Derived rows with those of the new rows' media exchanged, as far as the new ones still hold."""
    ok = current(new, live)
    return base.join(ok.select("generation_id", "media_id").distinct(), ["generation_id", "media_id"], "left_anti").unionByName(ok)


def latest_generations(generations: DataFrame, referenced: DataFrame) -> DataFrame:
    """Ids kept: of each feature and pipeline the newest complete one, and all that are referenced."""
    w = Window.partitionBy("feature", "pipeline").orderBy(F.col("created_at").desc(), F.col("generation_id").desc())
    newest = generations.where("complete").withColumn("r", F.row_number().over(w)).where("r = 1").select("generation_id")
    return newest.union(generations.join(referenced, "generation_id", "left_semi").select("generation_id")).distinct()


def retire(generations: DataFrame, retained: DataFrame) -> DataFrame:
    return generations.join(retained.select("generation_id"), "generation_id", "left_anti")


def collectable(existing: DataFrame, *references: DataFrame) -> DataFrame:
    """Digests that nothing refers to."""
    kept = references[0].select("sha")
    for r in references[1:]:
        kept = kept.union(r.select("sha"))
    return existing.select("sha").distinct().join(kept.distinct(), "sha", "left_anti")


def pruned(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("generation_id").subtract(after.select("generation_id"))


def append_keys(new: DataFrame, existing: DataFrame, order: Column) -> DataFrame:
    """Dense native keys for new rows in their order, on from the largest one (from 1, if there is none)."""
    top = existing.agg(F.coalesce(F.max("native_key"), F.lit(0)).alias("_top"))  # one row
    return ordered_rank(new, [order]).join(F.broadcast(top), F.lit(True)).withColumn("native_key", F.col("_top") + F.col("rank") + 1).drop("_top", "rank")


def membership_digest(derived: DataFrame) -> DataFrame:
    """One row: rows and an order-free digest of (native_key, media_id, content_revision, access_epoch).

    Row hashes are combined by exclusive-or and sum, so no global order is needed; it is not the
    digest of the ordered rows. The sum of 48-bit hashes passes a long's range at some 65,000 rows, so it is a decimal's.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "native_key", "media_id", "content_revision", "access_epoch"), 256), 1, 12), 16, 10).cast("long")
    return derived.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("sum"))


def dedup_bytes(files: DataFrame) -> DataFrame:
    return files.groupBy("sha").agg(F.max("size").alias("size")).agg(F.sum("size").cast("long").alias("bytes"))


def reclaimable(files: DataFrame, retained: DataFrame) -> DataFrame:
    return dedup_bytes(files.join(retained.select("sha").distinct(), "sha", "left_anti"))
