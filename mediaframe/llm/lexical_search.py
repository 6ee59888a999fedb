"""Ranked lexical search over hashed max-sketches of the documents.

A document's sketch holds, for each coordinate that any of its terms hashes to, the largest count of
such a term. A term's impact grows with its count, so at the document's length the sketch gives the
coordinatewise maximum of impacts, and for every query an upper bound of the score. Sketches depend on
nothing but their document, so the index outlives changes of the corpus' statistics.

A search bounds all documents for a block of queries by lookups in the sketches. Exact scores of the
highest bounds give each query a threshold; every document whose bound reaches it is then scored
exactly. What stays below cannot be among the best.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mediaframe.llm.arrays import MARKS, mix, split_words, texts_in_blocks
from mediaframe.llm.sqltext import with_key
from mediaframe.plans.lineage import cut_lineage, shared_folder

WIDTH, BEST, FIRST, QUERIES, MOST_IDS = 1 << 13, 10, 50, 512, 200_000
_FULL = 255  # a count of so many or more


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats; and for each distinct term of each text, in order: the text, its 64-bit hash, its count)."""
    words = split_words(column, lower=True, separators=MARKS)
    of = words.text_of()
    order = np.lexsort((words.hash, of))
    of, term = of[order], words.hash[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return words.count().astype(np.int64), of[at], term[at], np.diff(np.append(at, len(of)))


def coordinate(term: np.ndarray, width: int) -> np.ndarray:
    return (mix(term) % np.uint64(width)).astype(np.int64)


def _binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column of runs of `values`, which begin at `first` (one more than rows)."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(row, key, n, at, most): each document with terms, their number, and its sketch as sorted coordinates and counts.

    `row` is a hash of key and text, by which the text is found again. Written to the shared folder and read from there.
    """
    own = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))

    def sketch(batches):
        for b in batches:
            for lo, hi in texts_in_blocks(b.column(2)):
                some = b.slice(lo, hi - lo)
                n, of, term, count = term_counts(some.column(2))
                at = coordinate(term, width)
                place = of * width + at
                order = np.lexsort((count, place))
                last = np.append(np.diff(place[order]) != 0, True) if len(order) else np.zeros(0, bool)
                held = order[last]  # of each coordinate the largest count
                first = np.searchsorted(of[held], np.arange(hi - lo + 1))
                full = pa.array(n > 0)
                out = [some.column(0), some.column(1), pa.array(n), _binaries(at[held].astype("<u2"), first), _binaries(np.minimum(count[held], _FULL).astype(np.uint8), first)]
                yield pa.RecordBatch.from_arrays(out, names=["row", "key", "n", "at", "most"]).filter(full)

    schema = with_key(own.schema["key"].dataType, "n long, at binary, most binary")
    schema = type(schema)([own.schema["row"], *schema.fields])
    path = f"{shared_folder(docs.sparkSession)}/sketches-{uuid.uuid4().hex}"
    own.mapInArrow(sketch, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass
class Queries:
    """A block of queries: their distinct terms, and for each query its terms' numbers."""
    ids: list
    term: np.ndarray          # sorted hashes
    of: np.ndarray            # query of each (query, term)
    number: np.ndarray        # and the term's place in `term`
    weight: np.ndarray | None = None  # of each term


def query_blocks(queries: DataFrame, item: str, text: str, most: int = QUERIES) -> Iterator[Queries]:
    """The queries in blocks of about `most`; rows of one id are one query of all their terms."""
    q = queries.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    q = cut_lineage(q)
    blocks = max(1, -(-q.count() // most))
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect() if blocks > 1 else q.collect()
        _, of, term, _ = term_counts(pa.array([r["text"] for r in rows], pa.string()))
        distinct, number = np.unique(term, return_inverse=True)
        yield Queries([r["item"] for r in rows], distinct, of, number)


def document_counts(docs: DataFrame, text: str, term: np.ndarray) -> np.ndarray:
    """How many documents hold each of the sorted term hashes; a partition sends one row a term at most."""
    def count(batches):
        total = np.zeros(len(term), np.int64)
        for b in batches:
            for lo, hi in texts_in_blocks(b.column(0)):
                total += np.bincount(_places(term_counts(b.column(0).slice(lo, hi - lo))[2], term), minlength=len(term) + 1)[: len(term)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(term), np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a block's terms
        out[r.term] = r.n
    return out


def _places(found: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The number of each hash in the sorted `term`, and its length for those that are not there."""
    if not len(term):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(term, found), len(term) - 1)
    return np.where(term[at] == found, at, len(term))


def length_terms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document of n terms: 10 and 90 parts of its length against the mean, in whole numbers."""
    return np.array([10 + 90 * x * documents // terms for x in n.tolist()], np.int64)


def impacts(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * count // (1000 * count + 8 * m)


@dataclass
class Lookup:
    """A block of queries over sketches: which column of `table` a coordinate has (-1: none), and the weights of each query's terms added up there."""
    used: np.ndarray
    table: np.ndarray


def lookup(q: Queries, width: int) -> Lookup:
    at, column = np.unique(coordinate(q.term, width), return_inverse=True)
    used, table = np.full(width, -1, np.int64), np.zeros((len(at), len(q.ids)))
    used[at] = np.arange(len(at))
    np.add.at(table, (column[q.number], q.of), q.weight[q.number])
    return Lookup(used, table)


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer((column.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]], kind), np.diff(offsets) // np.dtype(kind).itemsize


def upper_bounds(n: np.ndarray, at: pa.Array, most: pa.Array, look: Lookup, documents: int, terms: int) -> np.ndarray:
    """(documents, queries): upper bounds of the scores; sums of whole numbers under 2^53, so exact."""
    coordinates, sizes = _values(at, "<u2")
    counts, _ = _values(most, "u1")
    row, column = np.repeat(np.arange(len(n)), sizes), look.used[coordinates]
    hit = np.flatnonzero(column >= 0)
    count, m = counts[hit].astype(np.int64), length_terms(n, documents, terms)[row[hit]]
    dense = np.zeros((len(n), len(look.table)))
    dense[row[hit], column[hit]] = np.where(count == _FULL, 1_000_000, impacts(count, m))
    return dense @ look.table


def exact_scores(texts: pa.Array, q: Queries, documents: int, terms: int) -> np.ndarray:
    """(documents, queries): the scores themselves."""
    n, of, term, count = term_counts(texts)
    place = _places(term, q.term)
    hit = np.flatnonzero(place < len(q.term))
    held, table = np.zeros((len(n), len(q.term))), np.zeros((len(q.term), len(q.ids)))
    held[of[hit], place[hit]] = impacts(count[hit], length_terms(n, documents, max(terms, 1))[of[hit]])
    table[q.number, q.of] = q.weight[q.number]
    return held @ table


def _blocks(batches, most: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, most):
            yield b.slice(lo, most)


def highest_bounds(index: DataFrame, q: Queries, look: Lookup, documents: int, terms: int, first: int) -> DataFrame:
    """(query, row): the `first` documents of highest bound for each query, as far as a bound is above 0. A partition sends so many a query."""
    def scan(batches):
        bound, rows = np.zeros((len(q.ids), first)), np.zeros((len(q.ids), first), np.int64)
        for b in _blocks(batches):
            some = upper_bounds(b.column(1).to_numpy(), b.column(2), b.column(3), look, documents, terms).T
            both, ids = np.hstack([bound, some]), np.hstack([rows, np.broadcast_to(b.column(0).to_numpy(), some.shape)])
            top = np.argpartition(-both, first - 1, axis=1)[:, :first]
            bound, rows = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        query, place = np.nonzero(bound > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rows[query, place]), pa.array(bound[query, place])], names=["query", "row", "bound"])

    best = index.select("row", "n", "at", "most").mapInArrow(scan, "query long, row long, bound double")
    w = Window.partitionBy("query").orderBy(F.col("bound").desc(), "row")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).select("query", "row")


def reaching(index: DataFrame, q: Queries, look: Lookup, documents: int, terms: int, threshold: np.ndarray) -> DataFrame:
    """(row, queries): the documents whose bound reaches the threshold of any query, and which."""
    def scan(batches):
        for b in _blocks(batches):
            over = upper_bounds(b.column(1).to_numpy(), b.column(2), b.column(3), look, documents, terms) >= threshold
            some = np.flatnonzero(over.any(axis=1))
            of, query = np.nonzero(over[some])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(some) + 1)).astype(np.int32)), pa.array(query.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), lists], names=["row", "queries"])

    return index.select("row", "n", "at", "most").mapInArrow(scan, "row long, queries array<int>")


def _scored(docs: DataFrame, candidates: DataFrame, q: Queries, documents: int, terms: int, threshold: np.ndarray, item_type, max_broadcast: int) -> DataFrame:
    """(item, key, score) of the candidates (row, queries; rows distinct) that reach the threshold; `docs` has row, key, text."""
    rows, pairs = candidates.agg(F.count("*"), F.sum(F.size("queries"))).first()
    small = rows <= max_broadcast and (pairs or 0) <= 10 * max_broadcast
    joined = docs.join(F.broadcast(candidates) if small else candidates, "row").select("key", "text", "queries")
    kind = pa.int64() if item_type.simpleString() == "bigint" else None

    def score(batches):
        for b in batches:
            for lo, hi in texts_in_blocks(b.column(1)):
                for some in _blocks([b.slice(lo, hi - lo)], 128):
                    scores = exact_scores(some.column(1), q, documents, terms)
                    wanted = np.zeros(scores.shape, bool)
                    lists = some.column(2)
                    wanted[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
                    of, query = np.nonzero(wanted & (scores >= threshold))
                    yield pa.RecordBatch.from_arrays([pa.array([q.ids[i] for i in query.tolist()], kind), some.column(0).take(pa.array(of)), pa.array(scores[of, query].astype(np.int64))], names=["item", "key", "score"])

    schema = with_key(joined.schema["key"].dataType, "score long")
    return joined.mapInArrow(score, type(schema)([type(schema.fields[0])("item", item_type), *schema.fields]))


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = BEST, index: DataFrame | None = None, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                   width: int = WIDTH, first: int = FIRST, max_queries: int = QUERIES, max_broadcast: int = MOST_IDS) -> DataFrame:
    """item, rank, key, score: the k documents of highest score above 0 for each query, ties by ascending key (nulls last).

    Terms are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII, told
    apart by 64-bit hashes. `index` is what `build_index` made of the same documents; without one it
    is built. Queries go to the tasks in blocks of about `max_queries`, whatever their number. Null or empty
    texts hold no terms and are never found; a query without terms finds nothing; queries of one id are
    one with all their terms; repeated documents each take a rank; an empty table of either kind gives
    an empty result; a text of any length is taken whole.
    """
    index = build_index(docs, key, text, width) if index is None else index
    documents, terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    item_type, out = queries.schema[item].dataType, None
    for q in query_blocks(queries, item, item_text, max_queries):
        seen = document_counts(docs, text, q.term)
        q.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in seen.tolist()], np.int64)
        look, least = lookup(q, width), np.ones(len(q.ids))
        high = cut_lineage(highest_bounds(index, q, look, documents, terms, first).groupBy("row").agg(F.collect_list(F.col("query").cast("int")).alias("queries")))
        tried = _scored(own, high, q, documents, terms, least, item_type, max_broadcast)
        w = Window.partitionBy("item").orderBy(F.col("score").desc())
        threshold = {r["item"]: r["score"] for r in tried.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("item", "score").collect()}  # a row a query of the block
        least = np.array([max(1, threshold.get(i, 1)) for i in q.ids], float)
        held = cut_lineage(reaching(index, q, look, documents, terms, least).dropDuplicates(["row"]))
        found = _scored(own, held, q, documents, terms, least, item_type, max_broadcast)
        out = found if out is None else out.union(found)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
