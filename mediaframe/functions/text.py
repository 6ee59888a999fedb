"""Search keys and recognised text."""
from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


@arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    # Some rows at a time, so that no batch stands in Python as objects.
    some = (text.slice(lo, 16).to_pylist() for lo in range(0, len(text), 16))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in x], pa.string()) for x in some)])


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function, so texts beyond ASCII, and only they, visit Python in Arrow batches."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(_nfc(F.when(~ascii_only, text)))


def search_key(text: Column) -> Column:
    """NFC, then lower case in no particular locale."""
    return F.lower(nfc(text))


def _tidy_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[\t ]+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def ocr_normalize(text: Column) -> Column:
    """NFC; each line trimmed, runs of tabs and blanks made one blank, empty lines dropped."""
    return _tidy_lines(nfc(text))


def _one_line(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("\n"), F.lit(" ")))


def ocr_search_key(text: Column) -> Column:
    return _one_line(ocr_normalize(text))


def typed(text: str) -> Column:
    """`search_key` of what a user typed, as a constant."""
    return F.lower(F.lit(unicodedata.normalize("NFC", text)))


def typed_ocr(text: str) -> Column:
    """`ocr_search_key` of what a user typed, as a constant."""
    return _one_line(_tidy_lines(F.lit(unicodedata.normalize("NFC", text))))


def contains_literal(key: Column, query: str | Column) -> Column:
    """Substring match in which %, _ and quotes mean themselves."""
    return F.contains(key, F.lit(query) if isinstance(query, str) else query)


#: Recognised text regions as they are stored: corners and text, from top to bottom.
REGIONS = "array<struct<text:string,confidence:double,left:double,top:double,right:double,bottom:double>>"


def regions_to_json(regions: Column) -> Column:
    return F.to_json(regions.cast(REGIONS))


def regions_from_json(text: Column) -> Column:
    """Regions of a stored JSON text; null where it is not one."""
    return F.from_json(text, REGIONS)
