"""Totals of what many shards count for the same hashes, by a tree of merges.

A unit (a shard) holds sorted distinct 64-bit hashes with counts, and wants each one's total over all
units and whether another unit holds it too (counts travel doubled, with that as the last bit). Up to `fan` units send their hashes in `fan` ranges straight to the task of each range. More
units are merged in groups of `fan` first, range by range; a merged list is one unit of the next
level, inside its range. So no unit writes more than `fan` rows, no task merges more than `fan`
lists, and a hash that every shard holds reaches no task more than `fan` times.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FAN = 1024
REQUEST = "prefix long, unit long, part int, kind int, n long, keys binary, counts binary"
REPLY = "prefix long, unit long, part int, kind int, counts binary, total long, types long, once long, twice long"
_REQUEST = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
_REPLY = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def pack_keys(keys: np.ndarray, drop: int) -> bytes:
    """Sorted keys whose `drop` low bits are empty, as differences in byte planes; the highest, mostly empty plane is compressed."""
    short = keys >> np.uint64(drop)
    steps = np.diff(short, prepend=np.uint64(0))
    wide = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(keys) > 1 else 1
    planes = np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return short[:1].tobytes() + bytes([wide, drop]) + planes[:-1].tobytes() + zlib.compress(planes[-1].tobytes(), 1)


def unpack_keys(blob: bytes, n: int) -> tuple[np.ndarray, int]:
    wide, drop, low = blob[8], blob[9], (n - 1) * (blob[8] - 1)
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(blob[:8], np.uint8)
    planes = np.frombuffer(blob[10 : 10 + low] + zlib.decompress(blob[10 + low :]), np.uint8)
    steps[1:, :wide] = planes.reshape(wide, n - 1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(drop), drop


def pack_counts(counts: np.ndarray) -> bytes:
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if int(counts.max(initial=0)) <= np.iinfo(t).max)
    return kind[-1].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[:1].decode()}").astype(np.int64)


def _step(fraction: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of equal ranges each key is in, and its place in that range scaled to all 64 bits."""
    p = np.uint64(parts)
    return (((fraction >> _HALF) * p + (((fraction & _LOW) * p) >> _HALF)) >> _HALF).astype(np.int64), fraction * p


def requests(unit: int, kind: int, keys: np.ndarray, counts: np.ndarray, units: int, fan: int = FAN, drop: int = 0, prefix: int = 0, above: tuple[int, ...] = ()) -> list[tuple]:
    """Rows of one unit's sorted keys, a row for each range that holds any; `counts` are doubled."""
    fraction = keys
    for parts in above:
        _, fraction = _step(fraction, parts)
    part, _ = _step(fraction, min(units, fan))
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else [0]
    return [(prefix, unit, int(part[lo]), kind, hi - lo, pack_keys(keys[lo:hi], drop), pack_counts(counts[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]


def table_of(rows: list[tuple], kinds, schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def request_table(rows: list[tuple]) -> pa.Table:
    return table_of(rows, _REQUEST, REQUEST)


def _merged(table: pa.Table):
    """For each kind: its rows' numbers and lengths, distinct keys, each given key's number, summed counts with the bit, dropped bits."""
    kind, n = table["kind"].to_numpy(), table["n"].to_numpy()
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        lists = [unpack_keys(table["keys"][int(i)].as_py(), int(n[i])) for i in rows]
        keys, inverse = np.unique(np.concatenate([x for x, _ in lists]), return_inverse=True)
        given = np.concatenate([unpack_counts(table["counts"][int(i)].as_py()) for i in rows])
        sums = np.bincount(inverse, weights=given >> 1, minlength=len(keys)).astype(np.int64) << 1
        sums |= np.bincount(inverse, weights=1 + (given & 1), minlength=len(keys)) > 1
        yield int(k), rows, n[rows], keys, inverse, sums, lists[0][1]


def _replies(table: pa.Table, kind: int, rows: np.ndarray, n: np.ndarray, inverse: np.ndarray, totals: np.ndarray) -> list[tuple]:
    at = np.cumsum([0, *n])
    return [(table["prefix"][int(i)].as_py(), table["unit"][int(i)].as_py(), table["part"][int(i)].as_py(), kind, pack_counts(totals[inverse[lo:hi]]), 0, 0, 0, 0) for i, lo, hi in zip(rows, at, at[1:])]


def total_counts(asked: DataFrame, units: int, fan: int = FAN, above: tuple[int, ...] = ()) -> DataFrame:
    """Replies to `asked` rows (REQUEST), each with the totals of its keys in order; and rows of unit -1 with the sums over all keys of a kind:
    of counts, of keys with any, of keys counted once, and of those counted twice."""
    parts = min(units, fan)

    def answer(table: pa.Table) -> pa.Table:
        out = []
        for kind, rows, n, keys, inverse, sums, _ in _merged(table):
            out += _replies(table, kind, rows, n, inverse, sums)
            total = sums >> 1
            out.append((0, -1, 0, kind, b"", int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))
        return table_of(out, _REPLY, REPLY)

    if units <= fan:
        return asked.groupBy("prefix", "part").applyInArrow(answer, REPLY)

    up = -(-units // fan)

    def combine(table: pa.Table) -> pa.Table:
        prefix, part, group = (table[c][0].as_py() for c in ("prefix", "part", "group"))
        out = []
        for kind, _, _, keys, _, sums, drop in _merged(table):
            out += requests(group, kind, keys, sums, up, fan, drop, prefix * parts + part, (*above, parts))
        return request_table(out)

    def split(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        kind_of, sub = replies["kind"].to_numpy(), replies["sub"].to_numpy()
        for kind, rows, n, keys, inverse, _, _ in _merged(table) if table.num_rows else ():
            mine = np.flatnonzero(kind_of == kind)
            mine = mine[np.argsort(sub[mine])]
            totals = np.concatenate([unpack_counts(replies["counts"][int(i)].as_py()) for i in mine])
            out += _replies(table, kind, rows, n, inverse, totals)
        return table_of(out, _REPLY, REPLY)

    group = ["prefix", "part", "group"]
    grouped = asked.withColumn("group", F.floor(F.col("unit") / fan).cast("long")).groupBy(*group)
    totals = total_counts(grouped.applyInArrow(combine, REQUEST), up, fan, (*above, parts))
    back = totals.where("unit >= 0").select(F.floor(F.col("prefix") / parts).cast("long").alias("prefix"), F.pmod("prefix", F.lit(parts)).cast("int").alias("part"), F.col("unit").alias("group"), F.col("part").alias("sub"), "kind", "counts")
    return grouped.cogroup(back.groupBy(*group)).applyInArrow(split, REPLY).union(totals.where("unit < 0"))


def totals_of(replies: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """One unit's totals of a kind, in the order of its keys, and whether other units hold them."""
    rows = np.flatnonzero(replies["kind"].to_numpy() == kind)
    rows = rows[np.argsort(replies["part"].to_numpy()[rows])]
    both = np.concatenate([unpack_counts(replies["counts"][int(i)].as_py()) for i in rows]) if len(rows) else np.empty(0, np.int64)
    return both >> 1, both & 1 == 1
