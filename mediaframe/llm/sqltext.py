"""Column expressions for words, used by the operators that stay inside Spark SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` evaluated once, though `use` names it many times or in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are; the fast way where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _parts(text: Column, separators: str) -> Column:
    """Pieces between runs of separators, without the empty ones that a run at an end leaves."""
    def inner(w: Column) -> Column:
        lead = (w[0] == "").cast("int")
        trail = ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
        return F.slice(w, lead + 1, F.size(w) - lead - trail)

    return let(F.split(F.coalesce(text, F.lit("")), separators), inner)


def space_words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+; null and blank texts give an empty array."""
    return _parts(text, r"[\x20\x09-\x0D]+")


def alnum_words(text: Column) -> Column:
    """Array of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return _parts(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def with_key(kind: DataType, rest: str) -> StructType:
    """Schema of a `key` of exactly the given type and the columns of a DDL string."""
    return StructType([StructField("key", kind), *StructType.fromDDL(rest).fields])
