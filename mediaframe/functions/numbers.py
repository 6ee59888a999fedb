"""Vectors, bits and identities as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """-1 where either norm is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(-1.0))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; an error for a zero or non-finite one."""
    n = norm(v)
    return F.when(finite(v) & (n > 0), F.transform(v, lambda x: x / n)).otherwise(F.raise_error(F.lit("vector has no direction")).cast("array<double>"))


def softmax_first(a: Column, b: Column) -> Column:
    """First probability of a softmax over two logits, without overflow."""
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes with left, top, right, bottom."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: (x["right"] - x["left"]) * (x["bottom"] - x["top"])
    both = side("left", "right") * side("top", "bottom")
    return both / (area(a) + area(b) - both)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def nibble(bits: Column, band: Column | int) -> Column:
    return F.call_function("shiftright", bits, (F.lit(band) if isinstance(band, int) else band) * 4).bitwiseAND(F.lit(15).cast("long"))


def median_hash(vector: Column, n: int = 63) -> Column:
    """Bit i says that element i is not under the upper median of the first n."""
    head = F.slice(vector, 1, n)
    middle = F.sort_array(head)[n // 2]
    marks = F.transform(head, lambda x, i: F.when(x >= middle, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def framed(*columns: Column) -> Column:
    """Parts with their lengths before them, so that no two lists of parts look alike."""
    return F.concat(*[x for c in columns for x in (F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))])


def device_identity(volume: Column, version: Column, row: Column, generation: Column) -> Column:
    return F.concat(F.lit("device:"), F.sha2(framed(volume, version, row, generation), 256))


def face_anchor(media: Column, *box: Column) -> Column:
    """Stable id of a face: the box in rounded hundredths (halves to even) outlives detector jitter."""
    parts = [F.bround(c.cast("double") * 100).cast("long").cast("string") for c in box]
    return F.sha2(F.concat_ws(":", media, *parts), 256)
