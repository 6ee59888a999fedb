"""Exact and near duplicates of media."""
from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from mediaframe.functions.numbers import nibble
from mediaframe.operators.fence import FENCE, current
from mediaframe.plans.lineage import cut_lineage
from mediaframe.plans.paging import page, page_after
from mediaframe.plans.rank import ordered_rank

BANDS, MAX_DISTANCE, TOP, TILE = 16, 14, 8, 1 << 17
MOST_IN_TILES, RANGE, BLOCK = 1 << 24, 1 << 17, 21
PARTS, TOGETHER, AT_ONCE = ((0, 13), (13, 13), (26, 13), (39, 12), (51, 12)), 4, 1 << 20
MASK = (1 << BLOCK) - 1


def fingerprint(live: DataFrame, content: DataFrame, decoder: Callable[[Column], Column] | None = None, failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fence, sha, and with a decoder bits) of each live row's content; and the fences of rows that fail.

    `decoder` makes the perceptual hash from the content column and gives null where it cannot. Rows
    of a fence in `failures` are not tried again: they fail until the media is revised or granted anew.
    """
    tried = live.select(*FENCE) if failures is None else live.select(*FENCE).join(failures.select(*FENCE), FENCE, "left_anti")
    joined = tried.join(content, "media_id", "left").withColumn("sha", F.sha2("content", 256))
    good, columns = F.col("content").isNotNull(), ["sha"]
    if decoder is not None:
        joined, columns = joined.withColumn("bits", decoder(F.col("content"))), ["sha", "bits"]
        good = good & F.col("bits").isNotNull()
    return joined.where(good).select(*FENCE, *columns), joined.where(~good).select(*FENCE)


_INDEX = np.arange(8)[:, None] * (2 * np.arange(32)[None, :] + 1) * np.pi / 64
_DCT = np.cos(_INDEX) * np.where(np.arange(8) == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))[:, None]


@pandas_udf(LongType())
def dct_hash(luma: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """63-bit perceptual hash of a luma raster; null where it does not fit its sizes. Rasters of one size are transformed together."""
    out = pd.Series([None] * len(luma), dtype="Int64", index=luma.index)
    size = pd.DataFrame({"w": width, "h": height, "n": luma.map(lambda x: -1 if x is None else len(x))})
    fits = size[(size["w"] > 0) & (size["h"] > 0) & (size["n"] == size["w"] * size["h"])]
    for (w, h), rows in fits.groupby(["w", "h"]):
        raster = np.stack([np.asarray(x, float) for x in luma[rows.index]]).reshape(-1, int(h), int(w))
        small = raster[:, (np.arange(32) * int(h)) // 32][:, :, (np.arange(32) * int(w)) // 32]
        low = np.round((_DCT @ small @ _DCT.T).reshape(len(rows), -1)[:, 1:], 6)  # flat directions are zeros, not noise
        on = low >= np.sort(low, axis=1)[:, 31:32]
        out[rows.index] = (on * (np.int64(1) << np.arange(63))).sum(axis=1)
    return out


_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


@pandas_udf(LongType())
def text_hash(text: pd.Series) -> pd.Series:
    """60-bit perceptual hash of a text: the bits set in more than half of its two-word pieces' MD5; null stays null, a text of under two words has 0."""
    def one(t: str | None):
        if t is None:
            return None
        w = t.encode().translate(_BLANKS).split(b" ")
        w = [x for x in w if x] if b"" in w else w
        if len(w) < 2:
            return 0
        digests = np.frombuffer(b"".join([md5(p).digest() for p in map(b" ".join, zip(w, w[1:]))]), np.uint8).reshape(-1, 16)
        bits = 2 * np.unpackbits(digests[:, :8], axis=1).sum(axis=0) > len(digests)
        return int.from_bytes(np.packbits(bits).tobytes(), "big") >> 4

    md5 = partial(hashlib.md5, usedforsecurity=False)
    return pd.Series([one(t) for t in text], dtype="Int64", index=text.index)


def bands(fp: DataFrame, key: str = "id", bits: str = "bits") -> DataFrame:
    """(key, bits, band, value): the sixteen nibbles of each hash."""
    return fp.select(key, bits, F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).withColumn("value", nibble(F.col(bits), F.col("band")))


def near_pairs(fp: DataFrame, max_distance: int = MAX_DISTANCE, key: str = "id", bits: str = "bits", tile: int = TILE, most_in_tiles: int = MOST_IN_TILES) -> DataFrame:
    """(left_bits, right_bits, distance) of different hashes within the distance; equal hashes are collapsed first.

    Up to `most_in_tiles` distinct hashes (counted) are compared tile by tile; two tiles meet in numpy through
    parts of their hashes, so that a tenth of the pairs is looked at; see `_close`. Beyond, hashes are cut into
    three blocks of 21 bits, one of which differs in a third of the bits at most; see `_meetings`. Both give the same pairs.
    """
    distinct = cut_lineage(fp.select(F.col(bits).alias("b")).where("b is not null").distinct())
    n = distinct.count()
    dealt = _tiles(distinct, n, tile) if n <= most_in_tiles else _meetings(distinct, max_distance // 3, tile)
    return dealt.mapInArrow(lambda batches: _compare(batches, max_distance), "left_bits long, right_bits long, distance int")


def _tiles(distinct: DataFrame, n: int, tile: int) -> DataFrame:
    """(block, value, t1, t2, own, b): each hash once in every pair of tiles that holds its own."""
    tiles = max(1, -(-n // tile), min(8, n // 2048))
    dealt = distinct.withColumn("own", F.pmod(F.xxhash64("b"), F.lit(tiles)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    placed = dealt.select(F.lit(-1).alias("block"), F.lit(0).alias("value"), F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "b")
    return placed.repartition(tiles * (tiles + 1), "t1", "t2").sortWithinPartitions("t1", "t2")  # a number of its own: few bytes are much work here


def _flips(most: int, size: int = BLOCK) -> np.ndarray:
    """All numbers of `size` bits of which at most so many are set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(size), k)], np.int64)


def _by_part(left: np.ndarray, right: np.ndarray, shift: int, size: int, radius: int):
    """How many pairs differ in at most `radius` bits of one part; and a generator of (places in left, places in right) of all of them."""
    flips, values = _flips(radius, size), np.arange(1 << size)
    x, y = (((v >> shift) & ((1 << size) - 1)).astype(np.int64) for v in (left, right))
    of_x, of_y = np.bincount(x, minlength=1 << size), np.bincount(y, minlength=1 << size)
    met = sum(of_y[values ^ f] for f in flips)

    def pairs():
        rows, others = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
        x_from, y_from = (np.concatenate([[0], np.cumsum(n)]) for n in (of_x, of_y))
        for v in np.flatnonzero(of_x * met):
            near = v ^ flips
            n = of_y[near]
            at = np.repeat(y_from[near] - np.cumsum(n) + n, n) + np.arange(met[v])
            yield rows[x_from[v] : x_from[v + 1]], others[at]

    return int((of_x * met).sum()), pairs


def _close(left: np.ndarray, right: np.ndarray, most: int):
    """(place in left, place in right, distance) of all pairs of hashes of at most `most` different bits, each pair once, in pieces of about `AT_ONCE`.

    One of five parts of such hashes differs in a fifth of the bits at most, so hashes meet by the values of a part that
    are so close. A pair counts in the first such part. Where that saves nothing, all meet.
    """
    left, right = left.view(np.uint64), right.view(np.uint64)
    radius = most // len(PARTS)
    ways = [_by_part(left, right, *part, radius) for part in PARTS] if radius <= 3 and len(left) * len(right) > 1 << 22 else []
    parts = [pairs() for _, pairs in ways]
    if not ways or sum(n for n, _ in ways) >= len(left) * len(right):
        parts = [[(np.arange(len(left)), np.arange(len(right)))]]
    held, size = [], 0
    for k, meetings in enumerate(parts):
        for rows, others in meetings:
            step, y = max(1, AT_ONCE // max(len(others), 1)), right[others]
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                differ = left[some][:, None] ^ y
                distance = np.bitwise_count(differ).ravel()
                hit = np.flatnonzero(distance <= most)
                if not len(hit):
                    continue
                found = differ.ravel()[hit]
                for shift, bits in PARTS[:k]:
                    new = np.bitwise_count((found >> shift) & ((1 << bits) - 1)) > radius
                    hit, found = hit[new], found[new]
                held.append((some[hit // len(others)], others[hit % len(others)], distance[hit].astype(np.int32)))
                size += len(hit)
                if size > AT_ONCE:
                    yield tuple(np.concatenate(c) for c in zip(*held))
                    held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _meetings(distinct: DataFrame, apart: int, tile: int) -> DataFrame:
    """(block, value, t1, t2, own, b): each hash under every value that its blocks reach with half of `apart` flipped bits.

    Two blocks that differ in `apart` bits or fewer reach a value together, half way between them. So a pair is
    looked at only where a block of both is close to the same value: a hundredth of all pairs, for
    hashes of no structure. Values that more than `tile` hashes reach are cut into tiles.
    """
    flips = _flips(-(-apart // 2))

    def spread(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.column(0).slice(lo, 2048).to_numpy()
                for k in range(3):
                    value = ((b[:, None] >> (BLOCK * k)) & MASK) ^ flips[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(value.size, k, np.int32)), pa.array(value.reshape(-1).astype(np.int32)), pa.array(np.repeat(b, len(flips)))], names=["block", "value", "b"])

    met = distinct.mapInArrow(spread, "block int, value int, b long")
    crowded = cut_lineage(met.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")))
    joined = met.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, ["block", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = joined.withColumn("own", F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["block", "value", "t1", "t2"]
    return own.select("block", "value", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "b").repartition(*keys).sortWithinPartitions(*keys)


def _half_way(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one value at which two blocks of at most four different bits report: x with the lower half of those bits flipped."""
    differ = x ^ y
    first = differ & -differ
    second = (differ ^ first) & -(differ ^ first)
    return x ^ first ^ np.where(np.bitwise_count(differ) > 2, second, 0)


def _compare(batches, max_distance: int):
    """Pairs of each group of rows that agree in block, value and tiles; a pair is reported in one group only."""
    held, place = [], None

    def done():
        own, b = (np.concatenate(x) for x in zip(*held))
        block, value, t1, t2 = place
        left, right = b[own == t1], b[own == t2]
        if block < 0:
            for i, j, d in _close(left, right, max_distance):
                x, y = left[i], right[j]
                keep = x < y if t1 == t2 else np.ones(len(x), bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(d[keep])], names=["left_bits", "right_bits", "distance"])
            return
        for lo in range(0, len(left), 512):
            some = left[lo : lo + 512]
            distance = np.bitwise_count(some[:, None] ^ right[None, :])
            i, j = np.nonzero(distance <= max_distance)
            x, y, d = some[i], right[j], distance[i, j].astype(np.int32)
            keep = x < y if t1 == t2 else np.ones(len(x), bool)
            x, y, d = np.minimum(x, y)[keep], np.maximum(x, y)[keep], d[keep]
            cut = lambda v, k: (v >> (BLOCK * k)) & MASK
            mine = (np.bitwise_count(cut(x, block) ^ cut(y, block)) <= max_distance // 3) & (_half_way(cut(x, block), cut(y, block)) == value)
            for k in range(block):  # an earlier block has reported it
                mine &= np.bitwise_count(cut(x, k) ^ cut(y, k)) > max_distance // 3
            x, y, d = x[mine], y[mine], d[mine]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(d)], names=["left_bits", "right_bits", "distance"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, own, b = np.stack([c.to_numpy() for c in batch.columns[:4]], axis=1), *(c.to_numpy() for c in batch.columns[4:])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
            here = tuple(keys[lo].tolist())
            if here != place:
                if held and sum(len(x) for x, _ in held) > 1:
                    yield from done()
                held, place = [], here
            held.append((own[lo:hi], b[lo:hi]))
    if held and sum(len(x) for x, _ in held) > 1:
        yield from done()


class _Closest:
    """The closest `top` later items of other content for each item of a tile, as tiles of later items pass in order.

    Items are arrays of rank, content and bits in the order of ranks. Members of hashes are never multiplied out: of a
    hash an item takes at most `top` members after its own rank, and steps over a run of its own content at once.
    """

    def __init__(self, rank, content, bits, most: int, top: int):
        self.rank, self.content, self.most, self.top = rank, content, most, top
        self.bits, of = np.unique(bits, return_inverse=True)
        self.members, self.size = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(self.bits))
        self.first = np.cumsum(self.size) - self.size
        self.far = np.full((len(rank), top), most + 1, np.int32)
        self.found = np.full((len(rank), top), -1, np.int64)

    def meet(self, rank, content, bits) -> None:
        hashes, of = np.unique(bits, return_inverse=True)
        order = np.argsort(of, kind="stable")
        of, rank, content = of[order], rank[order], content[order]
        ends = np.cumsum(np.bincount(of, minlength=len(hashes)))
        key = (of << 40) + rank
        turns = np.append(np.flatnonzero((content[1:] != content[:-1]) | (of[1:] != of[:-1])) + 1, len(of))
        other = turns[np.searchsorted(turns, np.arange(len(of)), "right")]  # the next place of another content or hash
        for left, right, far in _close(self.bits, hashes, self.most):
            by = np.argsort(far, kind="stable")  # what is close first, so that the rest is soon left out
            left, right, far = left[by], right[by], far[by]
            rows = np.cumsum(self.size[left])
            lo = 0
            while lo < len(left):
                hi = max(lo + 1, int(np.searchsorted(rows, (rows[lo - 1] if lo else 0) + AT_ONCE, "right")))
                n = self.size[left[lo:hi]]
                item = self.members[np.repeat(self.first[left[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                d, h = np.repeat(far[lo:hi], n), np.repeat(right[lo:hi], n)
                near = d <= np.minimum(self.far[item, -1], self.most)
                item, d, h = item[near], d[near], h[near]
                self._take(item, d, np.searchsorted(key, (h << 40) + self.rank[item], "right"), ends[h], rank, content, other)
                lo = hi

    def _take(self, item, d, at, end, rank, content, other) -> None:
        taken, count = [], np.zeros(len(item), np.int64)
        while True:
            go = (at < end) & (count < self.top)
            if not go.any():
                break
            item, d, at, end, count = item[go], d[go], at[go], end[go], count[go]
            own = content[at] == self.content[item]
            taken.append((item[~own], d[~own], rank[at[~own]]))
            at, count = np.where(own, other[at], at + 1), count + ~own
        if not taken:
            return
        item, d, r = (np.concatenate(c) for c in zip(*taken))
        some = np.unique(item)
        item = np.concatenate([np.repeat(some, self.top), item])
        d, r = np.concatenate([self.far[some].ravel(), d]), np.concatenate([self.found[some].ravel(), r])
        by = np.lexsort((r, d, item))
        item, d, r = item[by], d[by], r[by]
        first = np.searchsorted(item, some)[:, None] + np.arange(self.top)
        self.far[some], self.found[some] = d[first], r[first]

    def rows(self):
        i, k = np.nonzero(self.found >= 0)
        for lo in range(0, len(i), AT_ONCE):
            at = i[lo : lo + AT_ONCE], k[lo : lo + AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(self.rank[at[0]]), pa.array(self.found[at]), pa.array(self.far[at])], names=["left", "right", "distance"])


def _closest(batches, most: int, top: int):
    """`_Closest` over rows (t1, g, t2, rank, content, bits) in that order: a tile's own items (t2 = -1), then tiles from its own on."""
    here, held, state = None, [], None

    def run():
        nonlocal state
        columns = [np.concatenate(c) for c in zip(*held)]
        if here[2] < 0:
            state = _Closest(*columns, most, top)
        elif state is not None:
            state.meet(*columns)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, data = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1), [c.to_numpy() for c in batch.columns[3:]]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            now = tuple(keys[lo].tolist())
            if now != here:
                if held:
                    run()
                if here is not None and now[:2] != here[:2]:
                    yield from state.rows()
                here, held = now, []
            held.append([c[lo:hi] for c in data])
    if held:
        run()
        yield from state.rows()


def relations(fp: DataFrame, max_distance: int = MAX_DISTANCE, top: int = TOP, width: int = RANGE) -> DataFrame:
    """(left_id, right_id, distance): of each item its closest `top` later ones of other content; `fp` has id (distinct), sha, bits.

    Items in the order of ids are cut into tiles of at most `width`. A tile meets the tiles from its own on, `TOGETHER`
    of them in one task, one after the other; the task holds two tiles and the closest so far of each item, and returns
    these. So rows that are moved grow with the items and the tiles, never with pairs or with members of a hash.
    """
    m = cut_lineage(ordered_rank(fp.select("id", "sha", "bits").where("bits is not null"), [F.col("id")], "rank"))
    n = m.count()
    width = min(width, max(2048, -(-n // 8)))
    tiles = max(1, -(-n // width))
    content = m.groupBy("sha").agg(F.min("rank").alias("content"))
    item = cut_lineage(m.join(content, "sha").select(F.floor(F.col("rank") / width).cast("int").alias("tile"), "rank", "content", "bits"))
    group = lambda c: F.floor(c / TOGETHER).cast("int")
    left = item.select(F.col("tile").alias("t1"), F.explode(F.sequence(group(F.col("tile")), F.lit((tiles - 1) // TOGETHER))).alias("g"), F.lit(-1).alias("t2"), "rank", "content", "bits")
    right = item.select(F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("t1"), group(F.col("tile")).alias("g"), F.col("tile").alias("t2"), "rank", "content", "bits")
    tasks = tiles * (tiles // TOGETHER + 1)
    dealt = left.union(right).repartition(min(2 * tasks, max(1000, tasks // 10)), "t1", "g").sortWithinPartitions("t1", "g", "t2", "rank")
    found = dealt.mapInArrow(lambda batches: _closest(batches, max_distance, top), "left long, right long, distance int")
    w = Window.partitionBy("left").orderBy("distance", "right")
    best = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    name = lambda c: m.select(F.col("rank").alias(c), F.col("id").alias(f"{c}_id"))
    return best.join(name("left"), "left").join(name("right"), "right").select("left_id", "right_id", "distance")


def relations_page(relation: DataFrame, limit: int, cursor: dict | None = None) -> DataFrame:
    """A page of visual relations, closest first, then by left and right id, with has_next; from the start or strictly after a row."""
    order = [("distance", False), ("left_id", False), ("right_id", False)]
    return page(relation, [F.col(c).asc() for c, _ in order], limit) if cursor is None else page_after(relation, order, cursor, limit)


def exact_groups(fp: DataFrame) -> DataFrame:
    return fp.groupBy("sha").agg(F.count("*").alias("members")).where("members > 1")


def exact_members(fp: DataFrame, sha: str) -> DataFrame:
    return fp.where(F.col("sha") == sha).select("id")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).where("left_id <> right_id").distinct()


def exact_pairs(fp: DataFrame, requested: DataFrame) -> DataFrame:
    """Of the requested pairs (a, b) those of equal content; groups are never multiplied out."""
    side = lambda n: fp.select(F.col("id").alias(f"{n}_id"), F.col("sha").alias(f"{n}_sha"))
    return _ordered(requested).join(side("left"), "left_id").join(side("right"), "right_id").where("left_sha = right_sha").select("left_id", "right_id")


def resolve_pairs(requested: DataFrame, fp: DataFrame, relation: DataFrame) -> DataFrame:
    """Kind of each requested pair: EXACT before VISUAL; others are absent."""
    exact = exact_pairs(fp, requested).select("left_id", "right_id", F.lit("EXACT").alias("kind"), F.lit(0).alias("distance"))
    visual = _ordered(requested).join(relation, ["left_id", "right_id"]).select("left_id", "right_id", F.lit("VISUAL").alias("kind"), "distance")
    return exact.union(visual).groupBy("left_id", "right_id").agg(F.min(F.struct("kind", "distance")).alias("m")).select("left_id", "right_id", "m.kind", "m.distance")


def visible_relations(relation: DataFrame, fingerprints: DataFrame, live: DataFrame) -> DataFrame:
    """Relations both of whose sides have a current fingerprint of the version they were computed from."""
    now = current(fingerprints, live).select("media_id", "content_revision", "access_epoch")
    for side in ("left", "right"):
        relation = relation.join(now.select(*[F.col(c).alias(f"{side}_{c}") for c in FENCE]).withColumnRenamed(f"{side}_media_id", f"{side}_id"), [f"{side}_id", f"{side}_content_revision", f"{side}_access_epoch"], "left_semi")
    return relation


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): entered, left or changed between two snapshots, nulls compared as values."""
    side = lambda df, n: df.select(F.col(key).alias(key), F.struct(*columns).alias(n))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    change = F.when(F.col("o").isNull(), "entered").when(F.col("n").isNull(), "left").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def domain_revision(old: DataFrame, new: DataFrame, key: str = "media_id", columns: list[str] | None = None) -> DataFrame:
    """One row: how many changes to membership or listed columns."""
    return snapshot_diff(old, new, key, columns or FENCE[1:]).agg(F.count("*").alias("changes"))


def catalog_revision(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`domain_revision` over the columns that a reader of the catalogue names."""
    return domain_revision(old, new, key, columns)
