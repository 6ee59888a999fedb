"""Importance resampling of documents towards a target corpus, by hashed n-gram features.

Each batch interns its n-grams in an open-addressed numpy table, keyed by xxhash64 and verified
byte by byte, with a bucket and a count for each slot. Counts are added up by bucket over the
corpus; then every occurrence's slot fetches its bucket's gain.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm.arrays import LOWER, MARKS, flat_text, texts_in_blocks, word_bounds
from mediaframe.llm.slices import crc32_slices, equal_slices, xxh64_slices
from mediaframe.llm.sqltext import with_key
from mediaframe.plans.lineage import cut_lineage
from mediaframe.plans.rank import ordered_rank

BUCKETS, LONGEST, CHUNK, LEAST_WORDS = 10_000, 3, 1 << 16, 20


@dataclass
class Slots:
    """An open-addressed table: for each occurrence its slot; for each slot an occurrence, or -1, its bucket and its count."""
    of: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def intern(data: bytes, start: np.ndarray, end: np.ndarray, keys: np.ndarray, buckets: int) -> Slots:
    """Slots of the byte slices; `data` has eight bytes more than they use. All slices not yet placed probe their next slot at once."""
    room = 1 << max(4, (2 * len(start)).bit_length())
    first, slot = np.full(room, -1, np.int64), np.empty(len(start), np.int64)
    waiting, place = np.arange(len(start)), (keys & np.uint64(room - 1)).astype(np.int64)
    while len(waiting):
        free = first[place] < 0
        first[place[free]] = waiting[free]  # of several, one stays
        held = first[place]
        same = held == waiting
        other = np.flatnonzero(~same & (keys[held] == keys[waiting]) & (end[held] - start[held] == end[waiting] - start[waiting]))
        same[other] = equal_slices(data, start[held[other]], start[waiting[other]], end[waiting[other]] - start[waiting[other]])
        slot[waiting[same]] = place[same]
        waiting, place = waiting[~same], (place[~same] + 1) & (room - 1)
    used = np.flatnonzero(first >= 0)
    bucket = np.zeros(room, np.int64)
    bucket[used] = crc32_slices(data, start[first[used]], end[first[used]]) % buckets
    return Slots(slot, first, bucket, np.bincount(slot, minlength=room))


def interned(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[Slots, np.ndarray]]]:
    """Number of words of each text; and, for some words at a time, the table of the n-grams of 1 to `longest` words that begin there, with each occurrence's text."""
    raw, offsets = flat_text(column)
    lower = np.append(LOWER[raw], np.uint8(0))
    start, end, first = word_bounds(lower[:-1], offsets, MARKS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))

    def tables() -> Iterator[tuple[Slots, np.ndarray]]:
        for lo in range(0, len(start), CHUNK):
            hi, last = min(lo + CHUNK, len(start)), min(lo + CHUNK + longest - 1, len(start))
            # The words joined by one space, so that every n-gram is a slice.
            at = np.concatenate([[0], np.cumsum(end[lo:last] - start[lo:last] + 1)])
            joined = np.zeros(at[-1] + 8, np.uint8)
            joined[: at[-1]] = lower[np.arange(at[-1]) - np.repeat(at[:-1] - start[lo:last], np.diff(at))]
            joined[at[1:] - 1] = 0x20
            data = joined.tobytes()
            begins, ends, texts = [], [], []
            for n in range(1, longest + 1):
                i = np.arange(min(hi, last - n + 1) - lo)
                i = i[text[lo + i] == text[lo + i + n - 1]]
                begins.append(at[i])
                ends.append(at[i + n] - 1)
                texts.append(text[lo + i])
            a, b = np.concatenate(begins), np.concatenate(ends)
            yield intern(data, a, b, xxh64_slices(data, a, b), buckets), np.concatenate(texts)

    return np.diff(first), tables()


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; a partition sends at most one row a bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo, hi in texts_in_blocks(b.column(0)):
                for slots, _ in interned(b.column(0).slice(lo, hi - lo), longest, buckets)[1]:
                    total += np.bincount(slots.bucket, weights=slots.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets."""
    big_s, big_t, n = int(source.sum()) + len(source), int(target.sum()) + len(target), len(source)
    return np.array([math.floor(1000 * math.log((int(target[i]) + 1) * big_s / ((int(source[i]) + 1) * big_t))) for i in range(n)], np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """key, text_hash, n_words, n_features, weight: the sum of the gains of a row's n-grams. Null, empty and wordless texts weigh 0.

    Corpus and target are counted first; what comes to the driver and goes to tasks is one number a bucket.
    """
    gains = bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    own = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def weigh(batches):
        for b in batches:
            for lo, hi in texts_in_blocks(b.column(2)):
                some = b.slice(lo, hi - lo)
                words, tables = interned(some.column(2), longest, buckets)
                features, weight = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for slots, of in tables:
                    features += np.bincount(of, minlength=hi - lo)
                    gain = gains[slots.bucket]  # by slot, then by occurrence
                    weight += np.bincount(of, weights=gain[slots.of], minlength=hi - lo).astype(np.int64)  # whole numbers under 2^53
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)], names=["key", "text_hash", "n_words", "n_features", "weight"])

    weighed = own.mapInArrow(weigh, with_key(own.schema["key"].dataType, "text_hash long, n_words long, n_features long, weight long"))
    return weighed.withColumnRenamed("key", key)


def _drawn(docs: DataFrame, target: DataFrame, key: str, text: str, percent: int, least_words: int, seed: int, **options) -> DataFrame:
    weighed = cut_lineage(importance_weights(docs, target, key, text, **options).withColumnRenamed(key, "key").withColumn("row", F.monotonically_increasing_id()))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("open", F.col("n_words") >= least_words)
    drawn = percent * (weighed.agg(F.count_if(F.col("n_words") >= least_words)).first()[0]) // 100
    placed = ordered_rank(scored, [F.col("open").desc(), F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row").asc()], "place")
    return placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42, **options) -> DataFrame:
    """key, n_features, weight, score, rank: one row per row of `docs`; `rank` counts the drawn from 1, the others have none.

    Of the N rows with at least `least_words` words the floor(percent N / 100) of highest score are drawn,
    ties to the smaller id (null ids last), then repeated rows in any order. The score is the weight and
    Gumbel noise in thousandths, from a hash of seed and id, so rows drawn are a sample without replacement in
    proportion to the weights' exponentials; a null id's noise is that of the empty text. An empty table
    gives an empty result, an empty target counts of none; texts of any length are taken whole.
    """
    return _drawn(docs, target, key, text, percent, least_words, seed, **options).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42, **options) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `resample` draws; of repeated rows of one id and text all, if one is drawn."""
    own = lambda key, hash_: F.struct(F.col(key).alias("key"), hash_.alias("hash")).alias("_key")
    drawn = _drawn(docs, target, key, text, percent, least_words, seed, **options).where("rank is not null").select(own("key", F.col("text_hash"))).distinct()
    packed = docs.select(own(key, F.xxhash64(F.col(text))), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed.join(drawn, "_key", "left_semi").select("_row.*")
