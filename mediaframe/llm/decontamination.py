"""Benchmark windows in documents, by a prefix-filtered join on rare shingles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediaframe.llm.sqltext import alnum_words, let
from mediaframe.plans.lineage import cut_lineage

WINDOW, SHINGLE = 13, 5


def _windows(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(item, window, n): each item's distinct windows as joined words."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), alnum_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    starts = words.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    return starts.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("window"), "n").distinct()


def _none() -> Column:
    return F.array().cast("array<struct<key:bigint,size:int,pos:int>>")


def _hash(words: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from a place on, word by word: nothing is joined for it."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def _shingles(words: Column, n: Column, sizes: list[int]) -> Column:
    """array<struct<key, size, pos>> of all shingles of the given sizes."""
    def of(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(
            _hash(words, i, size).alias("key"), F.lit(size).alias("size"), i.alias("pos")))).otherwise(_none())

    return F.concat(*[of(s) for s in sizes])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text",
                  width: int = WINDOW, shingle: int = SHINGLE, min_share: float = 0.05, max_broadcast: int = 500_000) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated; one row per input row.

    A window must stand whole in a document, so by the prefix principle one shingle of it, the
    rarest by its count over all documents, has to. Documents' shingles meet the benchmark's; the
    hits of prefix shingles become candidate places if the window fits in (position and length),
    and the words there are compared. Null or empty texts have no words and no hits; null or empty
    items have no windows; items with a null id hit words but are not listed. Repeated rows each
    get their result; an empty table gives an empty result, an empty benchmark no hits; of a
    window's shingles that tie in rarity the first is taken; texts of any length are taken whole.
    Benchmark tables are broadcast only when their counted rows allow.
    """
    windows = cut_lineage(_windows(benchmark, item, item_text, width))
    distinct = windows.select("window", "n").distinct()
    cut = distinct.select("window", "n", F.least("n", F.lit(shingle)).alias("size"), F.split("window", " ").alias("w"))
    parts = cut.select("window", F.explode(F.concat(*[F.when(F.col("size") == s, _shingles(F.col("w"), F.col("n"), [s])).otherwise(_none()) for s in range(1, shingle + 1)])).alias("s"), "n").select(
        "window", "n", F.col("s.size").alias("size"), F.col("s.pos").alias("off"), F.col("s.key").alias("key"))
    wanted = parts.select("key", "size").distinct()
    shape = wanted.agg(F.count("*"), F.collect_set("size")).first()
    sizes, small = sorted(shape[1]) or [shingle], shape[0] <= max_broadcast
    hint = F.broadcast if small else (lambda df: df)

    own = docs.select(F.col(key).alias("key_"), F.xxhash64(F.col(text)).alias("digest"), alnum_words(F.col(text)).alias("w"))
    # The words are gone before shingles become rows: what is carried along is copied into each of them.
    listed_ = own.select("key_", "digest", F.size("w").alias("n_words"), let(F.col("w"), lambda w: _shingles(w, F.size(w), sizes)).alias("all"))
    spread = listed_.select("key_", "digest", "n_words", F.explode("all").alias("s")).select("key_", "digest", "n_words", "s.*")
    met = cut_lineage(spread.join(hint(wanted), ["key", "size"]).select("key_", "digest", "n_words", "key", "size", "pos"))

    counts = met.groupBy("key", "size").agg(F.count("*").alias("seen"))
    rarity = Window.partitionBy("window").orderBy("seen", "off")
    # Each window needs all its shingles: one that no document has rules the window out.
    prefix = parts.join(counts, ["key", "size"], "left").withColumn("seen", F.coalesce("seen", F.lit(0))).withColumn("rank", F.row_number().over(rarity)).where("rank = 1 and seen > 0").select("key", "size", "window", "n", "off")
    placed = met.join(hint(prefix), ["key", "size"]).withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 and start + n <= n_words")
    places = placed.groupBy("key_", "digest").agg(F.collect_set(F.struct("start", "n", "window")).alias("places"))

    whole = docs.select(F.col(key).alias("key_"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"))
    p = places.withColumnRenamed("key_", "p_key").withColumnRenamed("digest", "p_digest")
    joined = whole.join(p, F.col("key_").eqNullSafe(F.col("p_key")) & (F.col("digest") == F.col("p_digest")), "left").select("key_", "digest", alnum_words(F.col("text")).alias("w"), "places")

    def verified(w: Column, ps: Column) -> Column:
        return F.sort_array(F.filter(F.coalesce(ps, F.array().cast("array<struct<start:int,n:int,window:string>>")), lambda x: F.array_join(F.slice(w, x["start"] + 1, x["n"]), " ") == x["window"]))

    def covered(ps: Column) -> Column:
        return F.aggregate(ps, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["start"] + x["n"]).alias("end")), lambda acc: acc["n"])

    hits = cut_lineage(joined.select("key_", "digest", F.size("w").cast("long").alias("n_words"), verified(F.col("w"), F.col("places")).alias("hits")).select(
        F.monotonically_increasing_id().alias("row_"), "key_", "n_words", covered(F.col("hits")).alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["window"])).alias("windows")))
    named = windows.where("item is not null")
    named = F.broadcast(named) if named.count() <= max_broadcast else named  # else a window that many texts hold is one key of a shuffle
    listed = hits.where("n_hit > 0").select("row_", F.explode("windows").alias("window")).join(named, "window").groupBy("row_").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = hits.drop("windows").join(listed, "row_", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(F.col("key_").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (F.col("n_hit") >= min_share * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `decontaminate` does not find contaminated."""
    own = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"))
    found = decontaminate(docs.select(own.alias("_key"), F.col(text).alias("_text")), benchmark, "_text", "_key", **options).where("contaminated").select("_key").distinct()
    packed = docs.select(own.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed.join(found, "_key", "left_anti").select("_row.*")
