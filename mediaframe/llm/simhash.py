"""Near-duplicates by SimHash, compared tile by tile."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.llm import near_copies
from mediaframe.llm.sqltext import ascii_lower, let, space_words, with_key
from mediaframe.plans.graph import connected_components
from mediaframe.plans.lineage import cut_lineage

SHINGLE, RADIUS, TILE, SUBTILE = 3, 2, 8192, 512


def _shingle_hashes(text: Column, size: int) -> Column:
    def of(w: Column) -> Column:
        slide = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, size), " ")))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, slide).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(space_words(ascii_lower(text)), of)


def majority_bits(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of 64-bit values, the bits set in over half of them; 0 for an empty run."""
    n, out = np.diff(first), np.zeros(len(first) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    lo = 0
    while lo < len(n):  # about a million values at a time
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (1 << 18), "right")) - 1)
        some = np.flatnonzero(n[lo:hi]) + lo
        if len(some):
            ones = np.zeros((len(some), 64), np.int64)
            at = first[some]
            bits = np.unpackbits(np.ascontiguousarray(values[first[lo] : first[hi]]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += np.add.reduceat(bits, at - first[lo], axis=0, dtype=np.int32)
            out[some] = ((2 * ones > n[some, None]) * weights).sum(axis=1, dtype=np.uint64)
        lo = hi
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """key, fingerprint (long). A null text counts as empty; texts without words have fingerprint 0."""
    hashed = docs.select(F.col(key).alias("key"), _shingle_hashes(F.col(text), size).alias("h"))

    def bits(batches):
        for b in batches:
            h = b.column(1)
            first = h.offsets.to_numpy().astype(np.int64)
            values = h.values.to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(majority_bits(values, first).view(np.int64))], names=["key", "fingerprint"])

    return hashed.mapInArrow(bits, with_key(hashed.schema["key"].dataType, "fingerprint long"))


def link_tile(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (values) of the links at `radius` bits or fewer inside and between two tiles.

    Tiles are ordered by population count and cut into subtiles; two subtiles whose counts are
    more than the radius apart are skipped, the others compared by exclusive-or and bit count.
    """
    both = np.unique(np.concatenate([left, right]))
    count = np.bitwise_count(both).astype(np.int16)
    order = np.argsort(count, kind="stable")
    fp, count = both[order], count[order]
    group, out = np.arange(len(fp)), []
    for a in range(0, len(fp), SUBTILE):
        a_end = min(a + SUBTILE, len(fp))
        for b in range(a, len(fp), SUBTILE):
            if count[b] - count[a_end - 1] > radius:
                break
            b_end = min(b + SUBTILE, len(fp))
            i, j = np.nonzero(np.bitwise_count(fp[a:a_end, None] ^ fp[None, b:b_end]) <= radius)
            i, j = i + a, j + b
            i, j = i[i < j], j[i < j]
            apart = group[i] != group[j]
            while apart.any():
                i, j = i[apart], j[apart]
                out.append((int(fp[i[0]]), int(fp[j[0]])))
                group[group == group[j[0]]] = group[i[0]]
                apart = group[i] != group[j]
    return out


def _block_masks(n: int, radius: int) -> list[int]:
    """Bit masks one of which two values at `radius` bits or fewer must agree under.

    With m blocks, radius differing bits touch at most `radius` of them, so some m - radius blocks
    agree. More blocks give longer keys, taken when there are more values.
    """
    from itertools import combinations

    m = radius + 1 if n < 1 << 26 else radius + 2 if n < 1 << 36 else radius + 3
    edges = [round(64 * i / m) for i in range(m + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, m - radius)]


def fingerprint_links(values: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect what chains of distances up to `radius` connect; `values` has distinct longs `fp`.

    Values that agree under one of the masks meet in a tile. A group above `tile` values is dealt
    into several tiles and each pair of them is compared, so no task holds more than two tiles.
    """
    n = values.count()
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(signed(m)).cast("long").alias("bits")) for i, m in enumerate(_block_masks(n, radius))])
    keyed = values.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("value"))
    sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("size")).where("size > 1")
    crowded = keyed.join(sizes, ["mask", "value"])
    tiles = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    dealt = crowded.withColumn("tiles", tiles).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "fp", "mask", "value", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"))
    group = ["mask", "value", "t1", "t2"]
    sorted_ = dealt.repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        held, name = [], None
        empty = np.empty(0, np.uint64)

        def done():
            found = link_tile(np.concatenate(held), empty, radius) if held else []
            if found:
                a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy().view(np.uint64)
            ids = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(1, 5)], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)]):
                if name is not None and tuple(ids[lo]) != name:
                    yield from done()
                    held = []
                name = tuple(ids[lo])
                held.append(fp[lo:hi])
        yield from done()

    return sorted_.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id; one row per input row.

    component_id is the smallest key reachable over links of `radius` bits or fewer. Equal
    fingerprints are collapsed first, so a group of copies counts once. Rows with a null key get
    their component's smallest key (null if it has none) and name no component. Null and empty
    texts have fingerprint zero; repeated rows and rows of one key each get their result; an empty
    table gives an empty result; a text of any length is one row's array of hashes. A bit that
    exactly half of the hashes set is 0.
    """
    marked = cut_lineage(fingerprints(docs, text, key, size))
    distinct = cut_lineage(marked.groupBy("fingerprint").agg(F.min("key").alias("least")))
    parts = connected_components(fingerprint_links(distinct.select(F.col("fingerprint").alias("fp")), radius))
    owned = distinct.join(parts.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    names = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    final = owned.join(names, "component").select("fingerprint", "component_id")
    return marked.join(final, "fingerprint").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """One row of `docs`, all columns as they are, of each group of near copies: that of its smallest key.

    Near copies are chains of texts whose sets of `size`-word shingles have a Jaccard similarity of
    `similarity` or more; at that similarity fingerprints of 64 bits differ in about ten, too many
    to look up. Rows without a key come last; of rows with one and the same key the text with the
    smallest hash stays; of wholly repeated rows any one does.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"))
    packed = docs.select(own.alias("_key"), F.col(text).alias("_text"), row.alias("_row"))
    stay = near_copies.near_copies(packed, "_text", "_key", size, similarity).where("_key = component_id").select("_key").distinct()
    return packed.join(stay, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*")
