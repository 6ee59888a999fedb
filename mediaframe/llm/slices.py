"""XXH64 and CRC-32 of many slices of one byte string at once: slices of one length go through the steps together."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

#: XXH64's fixed values.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: CRC-32's reversed polynomial.
_POLYNOMIAL = 0xEDB88320
_FEW = 12


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out


_CRC = _crc_table()
_CRC2 = _CRC[(_CRC[np.arange(1 << 16) & 0xFF] ^ (np.arange(1 << 16) >> 8).astype(np.uint32)) & 0xFF] ^ (_CRC[np.arange(1 << 16) & 0xFF] >> 8)  # of two bytes


def eight_bytes(data: bytes) -> np.ndarray:
    """The little-endian number in the eight bytes from each place on; the last seven places have none."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def _by_length(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    size = end - start
    order = np.argsort(size.astype(np.int32), kind="stable")
    sizes = size[order]
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(order)] if len(order) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        yield int(sizes[lo]), order[lo:hi]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64_slices(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each slice; `data` goes on for eight bytes at least after the last of them."""
    out, eights, zero = np.empty(len(start), np.uint64), eight_bytes(data), np.uint64(0)
    with np.errstate(over="ignore"):
        for size, rows in _by_length(start, end):
            at = start[rows]
            if len(rows) < _FEW:
                out[rows] = [xxhash.xxh64_intdigest(data[i : i + size], seed) for i in at.tolist()]
                continue
            done = 0
            if size >= 32:
                s = np.uint64(seed)
                v = [np.full(len(rows), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while done + 32 <= size:
                    v = [_round(x, eights[at + done + 8 * k]) for k, x in enumerate(v)]
                    done += 32
                h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
                for x in v:
                    h = (h ^ _round(zero, x)) * P1 + P4
            else:
                h = np.full(len(rows), np.uint64(seed) + P5)
            h = h + np.uint64(size)
            while done + 8 <= size:
                h = _turn(h ^ _round(zero, eights[at + done]), 27) * P1 + P4
                done += 8
            if done < size:
                rest = eights[at + done]
                if done + 4 <= size:
                    h = _turn(h ^ (rest & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
                    rest, done = rest >> np.uint64(32), done + 4
                while done < size:
                    h = _turn(h ^ (rest & np.uint64(0xFF)) * P5, 11) * P1
                    rest, done = rest >> np.uint64(8), done + 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def crc32_slices(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice, as zlib has it, unsigned."""
    out, flat = np.empty(len(start), np.uint32), np.frombuffer(data, np.uint8)
    twos = np.ndarray(max(0, len(data) - 1), "<u2", data, strides=(1,))
    for size, rows in _by_length(start, end):
        at = start[rows]
        if len(rows) < _FEW:
            out[rows] = [zlib.crc32(data[i : i + size]) for i in at.tolist()]
            continue
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for k in range(0, size - 1, 2):
            crc = _CRC2[(crc ^ twos[at + k]) & 0xFFFF] ^ (crc >> 16)
        if size % 2:
            crc = _CRC[(crc ^ flat[at + size - 1]) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


def equal_slices(data: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray, short: int = 64) -> np.ndarray:
    """Whether `size` bytes from a and from b are the same; those of up to `short` bytes eight at a time."""
    eights, same = eight_bytes(data), np.ones(len(a), bool)
    left = np.flatnonzero(size <= short)
    for at in range(0, int(size[left].max(initial=0)), 8):
        left = left[size[left] > at]
        rest = np.minimum(size[left] - at, 8).astype(np.uint64)
        same[left] &= (eights[a[left] + at] ^ eights[b[left] + at]) << (np.uint64(64) - rest * np.uint64(8)) == 0
    for i in np.flatnonzero(size > short):
        same[i] = data[a[i] : a[i] + size[i]] == data[b[i] : b[i] + size[i]]
    return same
