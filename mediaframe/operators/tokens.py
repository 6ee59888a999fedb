"""Corpus tokenisation report against a vocabulary table of word pieces."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mediaframe.functions.text import nfc
from mediaframe.plans.lineage import cut_lineage

MOST_PIECES, WORDS_AT_ONCE, _CODES = 2_000_000, 1 << 18, 1 << 21


@dataclass
class Trie:
    """A vocabulary as a trie in flat arrays: edges sorted by parent and code point, the node each leads to, and which nodes end a piece."""
    edges: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> Trie:
        codes, first = _code_points(pa.array(pieces, pa.string()))
        size, node = np.diff(first), np.zeros(len(pieces), np.int64)
        edges, ends, rows, depth, known = [], [0], np.flatnonzero(size > 0), 0, 1
        while len(rows):
            level, child = np.unique(node[rows] * _CODES + codes[first[rows] + depth], return_inverse=True)
            node[rows] = known + child
            depth += 1
            whole = np.zeros(len(level), np.int64)
            whole[child[size[rows] == depth]] = 1
            edges.append(level)
            ends.append(whole)
            known += len(level)
            rows = rows[size[rows] > depth]
        # Nodes are numbered level by level, each level in the order of its edges: so the edges stand sorted already, and edge i leads to node i + 1.
        return cls(np.concatenate([*edges, np.zeros(0, np.int64)]), np.concatenate([np.atleast_1d(e) for e in ends]).astype(bool))

    def pieces(self, words: pa.Array) -> np.ndarray:
        """How many pieces each word is cut into, always the longest that fits next; -1 where none fits. All words walk at once."""
        codes, first = _code_points(words)
        begin, stop = first[:-1].copy(), first[1:]
        n, active = np.zeros(len(words), np.int64), np.flatnonzero(stop > begin)
        at, node, last = begin.copy(), np.zeros(len(words), np.int64), begin.copy()  # `last` is where the longest piece so far ends
        while len(active):
            here = at[active]
            open_ = here < stop[active]
            key = node[active] * _CODES + np.where(open_, codes[np.minimum(here, len(codes) - 1)], 0)
            edge = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            on = open_ & (self.edges[edge] == key) if len(self.edges) else np.zeros(len(active), bool)
            go = active[on]
            node[go] = edge[on] + 1
            at[go] += 1
            ended = go[self.ends[node[go]]]
            last[ended] = at[ended]
            cut = active[~on]  # no longer piece: cut after the last one
            stuck = cut[last[cut] == begin[cut]]
            n[stuck] = -1
            cut = cut[last[cut] > begin[cut]]
            n[cut] += 1
            begin[cut] = at[cut] = last[cut]
            node[cut] = 0
            active = np.concatenate([go, cut[begin[cut] < stop[cut]]])
        return n


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), first


def basic_words(text: Column) -> Column:
    """Words of a text in NFC and lower case, split at white space, with punctuation, symbols and Han characters by themselves."""
    spaced = F.regexp_replace(F.lower(nfc(text)), r"([\p{P}\p{S}\p{IsHan}])", " $1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def tokenize_corpus(docs: DataFrame, vocab: DataFrame, max_len: int = 77, most_pieces: int = MOST_PIECES) -> tuple[DataFrame, DataFrame]:
    """((doc_id, lang, tokens, truncated), (lang, words, unknown_rate)); documents without words are in neither.

    Each word is cut greedily into its longest pieces from `vocab` (piece); a word with a place where
    none fits is unknown and one token. A vocabulary of up to `most_pieces` distinct pieces, by count, goes
    to the tasks as a trie, which the distinct words of each batch walk; a larger one is joined.
    """
    worded = docs.select("doc_id", "lang", basic_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    pieces = cut_lineage(vocab.select("piece").where("piece <> ''").distinct())
    if pieces.count() <= most_pieces:
        each = _walked(worded, Trie.of([r.piece for r in pieces.collect()]))
    else:
        each = _joined(worded, pieces)
    tokens = each.select("doc_id", "lang", "tokens", (F.col("tokens") > max_len).alias("truncated"))
    rates = each.groupBy("lang").agg(F.sum("words").alias("words"), F.round(F.sum("unknown") / F.sum("words"), 6).alias("unknown_rate"))
    return tokens, rates


def _walked(worded: DataFrame, trie: Trie, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    def walk(batches):
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < whole.num_rows:  # some words at a time, so that memory does not grow with the batch
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + words_at_once, "right")))
                b, lo = whole.slice(lo, hi - lo), hi
                lists = b.column(2)
                flat = lists.flatten().dictionary_encode()
                n = trie.pieces(flat.dictionary.cast(pa.string()))
                word = n[flat.indices.to_numpy()]
                first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(add(np.where(word < 0, 1, word))), pa.array(np.diff(first)), pa.array(add((word < 0).astype(np.int64)))], names=["doc_id", "lang", "tokens", "words", "unknown"])

    schema = StructType([*worded.select("doc_id", "lang").schema.fields, *[StructField(c, LongType()) for c in ("tokens", "words", "unknown")]])
    return worded.mapInArrow(walk, schema)


def _joined(worded: DataFrame, pieces: DataFrame) -> DataFrame:
    """The same by joins: every place of every distinct word meets the pieces of each length that the vocabulary has."""
    counted = worded.select("doc_id", "lang", F.explode("w").alias("word")).groupBy("doc_id", "lang", "word").agg(F.count("*").alias("times"))
    lengths = sorted(r[0] for r in pieces.select(F.length("piece")).distinct().collect())  # as many as there are lengths
    sizes = F.array(*map(F.lit, lengths)).cast("array<int>")
    places = counted.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    tried = places.select("word", "at", F.explode(F.filter(sizes, lambda n: n <= F.length("word") - F.col("at") + 1)).alias("n")).withColumn("piece", F.expr("substring(word, at, n)"))
    longest = tried.join(pieces, "piece").groupBy("word", "at").agg(F.max("n").alias("n"))
    steps = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("step"))  # a word's places
    walk = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.struct(F.lit(1).alias("at"), F.lit(0).alias("n")), lambda s, i: F.when(
        (s["at"] == i) & F.col("step")[i].isNotNull(), F.struct((s["at"] + F.col("step")[i]).alias("at"), (s["n"] + 1).alias("n"))).otherwise(s))
    known = steps.select("word", walk.alias("w")).where(F.col("w.at") > F.length("word")).select("word", F.col("w.n").alias("pieces"))
    met = counted.join(known, "word", "left")
    return met.groupBy("doc_id", "lang").agg(F.sum(F.col("times") * F.coalesce("pieces", F.lit(1))).alias("tokens"), F.sum("times").alias("words"), F.sum(F.when(F.col("pieces").isNull(), F.col("times")).otherwise(0)).alias("unknown"))
