"""Exact dedup against a persistent index of text digests, bucketed and sorted by digest.

A batch brings its distinct digests once each; those that the index lacks are found by a sort-merge
anti-join, for which the index is read bucket by bucket and only the batch is shuffled, and are appended.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

from mediaframe.plans.lineage import cut_lineage

HOT_PARTS = 4


class DigestIndex:
    """Digests (digest binary, keep_id) in a folder that all executors share; the files outlive the session.

    `buckets` is fixed when the folder is first written and has to be given again when it is opened.
    Each append adds at most one file to a bucket, sorted by digest. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: DataType, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _named(self) -> str:
        """A passing name for the folder in the session's catalogue; dropping it leaves the files."""
        name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id {self.key.simpleString()}) USING parquet LOCATION '{self.path}' CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        return name

    def table(self) -> DataFrame:
        """The index as a bucketed table, as it is now."""
        name = self._named()
        try:
            return self.spark.table(name).select("digest", "keep_id")
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of `groups` (one a digest) whose digest the index lacks."""
        return groups.hint("merge").join(self.table(), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Adds (digest, keep_id) rows whose digests are not in the index yet."""
        name = self._named()
        try:  # a task is a bucket, so a bucket gets one file
            groups.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, digest): SHA-256 of each text's UTF-8, null counting as empty; `row` tells repeated rows apart."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256: one row per row of `docs`, whose new texts join the index.

    Texts are equal when identical; null is empty. Of texts new to the index the row of the largest
    id stays, in a tie (repeated rows, null ids) one of them; a null id stays only where no other has
    the text. A text of an earlier batch keeps that batch's row, so all of today's go, but for rows of
    that very id: they are that document come again (a batch that is run twice gives the same result).
    group_size counts this batch's rows. An empty table gives an empty result; a text of any length
    is taken whole; other columns are not looked at.

    Groups are counted before they are shuffled. Rows find their group in a join by digest, except those
    of groups that hold more than one part in 4 times the buckets of all rows: there are at most so many
    groups, and they are broadcast.
    """
    rows = cut_lineage(digest_rows(docs, key, text))
    top = F.max(F.struct("id", "row"))
    groups = cut_lineage(rows.groupBy("digest").agg(top.alias("top"), F.count("*").alias("size")).select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("top_row"), "size"))
    index.append(index.unseen(groups))
    known = index.table().withColumnRenamed("keep_id", "known_id").hint("merge")
    found = cut_lineage(groups.join(known, "digest").select("digest", F.col("known_id").alias("keep_id"), F.when(F.col("keep_id").eqNullSafe(F.col("known_id")), F.col("top_row")).alias("top_row"), "size"))
    most = (found.agg(F.sum("size")).first()[0] or 0) / (HOT_PARTS * index.buckets)
    hot = found.where(F.col("size") > most)
    joined = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(found.where(F.col("size") <= most), "digest")
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    kept = same & F.coalesce(F.col("row") == F.col("top_row"), F.lit(True))
    return joined.unionByName(rest).select(F.col("id").alias(key), "keep_id", F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def new_documents(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, that `deduplicate` keeps; their digests are in the index then.

    Repeated rows of one id and text are one document and come out once.
    """
    kept = deduplicate(docs, index, key, text).where("kept").select(F.struct(F.col(key).alias("key"), F.unhex("text_sha256").alias("digest")).alias("_key")).distinct()
    own = F.struct(F.col(key).alias("key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    packed = docs.select(own.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed.join(kept, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*")
