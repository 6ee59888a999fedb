"""Composable catalogue search, albums, folders and organising."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from mediaframe.functions.text import contains_literal, ocr_search_key, search_key, typed, typed_ocr
from mediaframe.functions.time import effective_at, in_date_range
from mediaframe.operators.fence import current, visible


@dataclass(frozen=True)
class CatalogSearch:
    """Conditions that must all hold; unset, empty and (for tag and recognised text) blank ones do not restrict.

    What is typed is normalised as the catalogue's keys are: NFC and lower case; a tag is trimmed; recognised
    text also has its blanks and lines made alike, and is looked for in one generation.
    """
    name: str | None = None
    start: str | None = None
    until: str | None = None
    source: str | None = None
    tag: str | None = None
    ocr: str | None = None
    ocr_generation: str | None = None
    album_id: str | None = None
    favorite: bool = False
    folder: tuple[str, str, str] | None = None  # volume, bucket, path
    include_protected: bool = False
    limit: int = 60
    offset: int = 0


def catalog_search(tables: dict[str, DataFrame], search: CatalogSearch) -> DataFrame:
    """Matching media, newest first, at most `limit` (1 to 120) after the first `offset`."""
    if not 1 <= search.limit <= 120 or search.offset < 0:
        raise ValueError("limit must be 1 to 120, offset 0 or more")
    v = visible(tables["media"], tables["exposure"], search.include_protected).withColumn("sort_at", effective_at(F.col("taken_at"), F.col("added_at")))
    if search.name:
        v = v.where(contains_literal(search_key(F.col("display_name")), typed(search.name)))
    if search.start or search.until:
        v = v.where(in_date_range(F.col("sort_at"), search.start, search.until))
    if search.source:
        v = v.where(F.col("source") == search.source)
    if search.folder:
        volume, bucket, path = search.folder
        v = v.where((F.col("source") == "DEVICE") & (F.col("volume_name") == volume) & (F.coalesce("bucket_id", F.lit("")) == bucket) & (F.coalesce("relative_path", F.lit("")) == path))
    if search.tag and search.tag.strip():
        v = having_tag(v, tables["media_tag"], search.tag)
    if search.album_id:
        v = v.join(tables["album_media"].where(F.col("album_id") == search.album_id), "media_id", "left_semi")
    if search.favorite:
        v = v.join(tables["favorite"], "media_id", "left_semi")
    if search.ocr and search.ocr.strip():
        if not search.ocr_generation:
            raise ValueError("recognised text is searched in a named generation")
        v = v.join(ocr_search(tables["ai_ocr_result"], v, search.ocr, search.ocr_generation), "media_id", "left_semi")
    return v.orderBy(F.col("sort_at").desc_nulls_last(), F.col("media_id").desc()).offset(search.offset).limit(search.limit)


def ocr_search(ocr: DataFrame, live: DataFrame, query: str, generation_id: str) -> DataFrame:
    """Recognised texts of a generation that still hold for a row of `live` and hold the query."""
    return current(ocr.where(F.col("generation_id") == generation_id), live).where(contains_literal(ocr_search_key(F.col("display_text")), typed_ocr(query)))


def having_tag(v: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Rows with a tag, as a user may type it."""
    return v.join(tags.where(F.col("tag_key") == typed(tag.strip())), "media_id", "left_semi")


def in_album(v: DataFrame, members: DataFrame, album_id: str) -> DataFrame:
    return v.join(members.where(F.col("album_id") == album_id), "media_id", "left_semi")


def favourites(v: DataFrame, favorite: DataFrame) -> DataFrame:
    return v.join(favorite, "media_id", "left_semi")


def by_keys(df: DataFrame, keys: DataFrame, key: str = "media_id") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def albums(album: DataFrame, members: DataFrame, media: DataFrame, exposure: DataFrame, include_protected: bool = False) -> DataFrame:
    """Albums with their counts of available members; empty ones count 0.

    As in the catalogue's own listing, without protected rows an album whose available members
    are all other than SAFE is absent, while one without any available member is listed with 0.
    """
    live = media.where("availability = 'AVAILABLE'").select("media_id", "content_revision")
    m = members.join(live, "media_id", "left").select("album_id", "media_id", "content_revision", F.col("content_revision").isNotNull().alias("live"))
    all_ = album.join(m, "album_id", "left")
    if not include_protected:
        safe = exposure.where("exposure = 'SAFE'").select("media_id", "content_revision", F.lit(True).alias("safe"))
        all_ = all_.join(safe, ["media_id", "content_revision"], "left").where(~F.coalesce("live", F.lit(False)) | F.coalesce("safe", F.lit(False)))
    return all_.groupBy("album_id", "name").agg(F.count_if(F.coalesce("live", F.lit(False))).alias("items"))


def folders(v: DataFrame) -> DataFrame:
    return v.where("source = 'DEVICE'").groupBy("volume_name", F.coalesce("bucket_id", F.lit("")).alias("bucket_id"), F.coalesce("relative_path", F.lit("")).alias("relative_path")).agg(F.max("bucket_name").alias("bucket_name"), F.count("*").alias("items"))


def organise(v: DataFrame, ids: DataFrame, existing: DataFrame, column: str, value: str, remove: bool = False) -> DataFrame:
    """The (media_id, column) table after adding or removing `value` for the visible ones of `ids`; doing it twice is doing it once."""
    chosen = by_keys(v, ids).select("media_id").distinct().withColumn(column, F.lit(value))
    if remove:
        return existing.join(chosen, ["media_id", column], "left_anti")
    return existing.unionByName(chosen.join(existing, ["media_id", column], "left_anti"))


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Temporary views of the named tables, for SQL over them; their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in tables]
