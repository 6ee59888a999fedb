"""Language-model scores by a weighted backoff automaton over counts of the whole corpus.

Texts are dealt into shards of bounded size. Each shard asks for the counts of its distinct
n-grams, which a tree of merges adds up over all shards, and then builds the part of the automaton
that its own texts can reach and walks them through it. From order 3 on it asks only for n-grams
whose two shorter ones both stand in other shards too: no others can.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.llm import exchange
from mediaframe.llm.arrays import join_hash, split_words
from mediaframe.llm.sqltext import with_key

ORDER, SHARD_BYTES, SPARE_BITS, SEGMENT = 3, 8 << 20, 22, 256
PARTITIONS = 50_000  # of the text shuffle at most; a partition then holds several shards, taken one after the other
_END = np.uint64(0xA0761D6478BD642F)


@dataclass
class Grams:
    """Tokens of a shard's texts and, for each order, the number of the n-gram that begins at each token."""
    first: np.ndarray            # first token of each text, one more than texts
    number: list[np.ndarray]     # by order: per token, -1 where the text ends before
    keys: list[np.ndarray]       # by order: sorted distinct hashes
    begin: list[np.ndarray]      # by order: a token at which each begins


def shard_grams(column: pa.Array, order: int, drop: int = 0) -> Grams:
    """Hashes of two words and more lose their `drop` low bits."""
    words = split_words(column, lower=True)
    n = words.count()
    first = np.concatenate([[0], np.cumsum(n + 1)])
    tokens = np.full(first[-1], _END)
    tokens[np.arange(len(words.hash)) + words.text_of()] = words.hash
    left = np.repeat(first[1:], n + 1) - np.arange(first[-1])  # tokens from here to the text's end
    hashed, number, keys, begin = tokens, [], [], []
    for k in range(1, order + 1):
        if k > 1:
            hashed = join_hash(hashed[: len(tokens) - k + 1], tokens[k - 1 :]) if len(tokens) >= k else hashed[:0]
        at = np.flatnonzero(left[: len(hashed)] >= k)
        unique, index, inverse = np.unique(hashed[at] if k == 1 else hashed[at] >> np.uint64(drop) << np.uint64(drop), return_index=True, return_inverse=True)
        ids = np.full(len(tokens), -1, np.int64)
        ids[at] = inverse
        number.append(ids)
        keys.append(unique)
        begin.append(at[index])
    return Grams(first, number, keys, begin)


def local_counts(grams: Grams, trained: np.ndarray) -> list[np.ndarray]:
    """By order: how often each n-gram begins at a trained token of the shard."""
    return [np.bincount(number[(number >= 0) & trained], minlength=len(keys)) for number, keys in zip(grams.number, grams.keys)]


def shared(grams: Grams, elsewhere: np.ndarray, k: int) -> np.ndarray:
    """Of the n-grams of k + 1 words: whether both shorter ones inside stand in other shards too."""
    at = grams.begin[k]
    return elsewhere[grams.number[k - 1][at]] & elsewhere[grams.number[k - 1][at + 1]]


def all_totals(grams: Grams, local: list[np.ndarray], replies: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """By order, up to `order`: counts over all shards; and of the last order, which stand in other shards too."""
    totals: list[np.ndarray] = []
    elsewhere = np.empty(0, bool)
    for k in range(order):
        whole, beyond = exchange.totals_of(replies, k)
        if k > 1:
            asked, answered, found = shared(grams, elsewhere, k), whole, beyond
            whole, beyond = local[k].copy(), np.zeros(len(local[k]), bool)
            whole[asked], beyond[asked] = answered, found
        totals.append(whole)
        elsewhere = beyond
    return totals, elsewhere


class Automaton:
    """States are the n-grams seen in training below the top order; an arc adds a word's interpolated
    log10 probability, a failure arc adds the weight of backing off and drops the oldest word."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, types: int, once: int, twice: int):
        order, self.words = len(grams.keys), max(1, len(grams.keys[0]))
        self.order = order
        discount = min(once / (once + 2 * twice), 0.95) if once else 0.5  # a word seen once keeps some of its count
        unseen = discount * types / tokens if tokens else 1.0
        c = totals[0]
        p = [np.where(c > 0, (c - discount) / max(tokens, 1), unseen)]
        heaps = math.log(types) / math.log(tokens) if tokens > 1 and types > 1 else 0.5
        backoff = lambda n: 1 / (1 + np.maximum(n, 1) ** (1 - heaps))  # noqa: E731  Witten-Bell, followers' types by Heaps' law
        offset = np.cumsum([1, *[len(k) for k in grams.keys]])
        states = int(offset[order - 1])
        self.fail, self.weight = np.zeros(states, np.int64), np.zeros(states)
        self.root_score = np.log10(p[0])
        self.root_next = np.where(c > 0, 1 + np.arange(len(c)), 0) if order > 1 else np.zeros(len(c), np.int64)
        keys, scores, nexts = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        for k in range(1, order):
            at = grams.begin[k - 1]
            mine = slice(int(offset[k - 1]), int(offset[k]))
            self.weight[mine] = np.log10(backoff(totals[k - 1]))
            if k > 1:
                self.fail[mine] = offset[k - 2] + grams.number[k - 2][at + 1]
            up = grams.begin[k]
            context, shorter, word = grams.number[k - 1][up], grams.number[k - 1][up + 1], grams.number[0][up + k]
            share = backoff(totals[k - 1][context])
            higher = (1 - share) * totals[k] / np.maximum(totals[k - 1][context], 1) + share * p[k - 1][shorter]
            p.append(higher)
            seen = totals[k] > 0
            keys.append(((offset[k - 1] + context) * self.words + word)[seen])
            scores.append(np.log10(higher[seen]))
            nexts.append((offset[k] + np.arange(len(up)) if k + 1 < order else offset[k - 1] + shorter)[seen])
        key = np.concatenate(keys)
        by = np.argsort(key)
        self.key, self.score, self.next = np.append(key[by], -1), np.append(np.concatenate(scores)[by], 0.0), np.append(np.concatenate(nexts)[by], 0)
        self.arcs = len(key)

    def walk(self, words: np.ndarray, first: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """Log10 probability of each text: all step from left to right together, each with its state.

        A state tells at most the last order - 1 words, so a long text is walked in segments; each but
        the first reads that many words before it, without counting them, to come into its state.
        """
        n, warm = np.diff(first), self.order - 1
        segment = max(segment, warm)
        many = np.maximum(-(-n // segment), 1)
        owner = np.repeat(np.arange(len(n)), many)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        skip = np.where(part > 0, warm, 0)
        begin = first[:-1][owner] + part * segment - skip
        size = np.minimum(begin + skip + segment, first[1:][owner]) - begin
        by = np.argsort(-size, kind="stable")
        owner, skip, begin, size = owner[by], skip[by], begin[by], size[by]
        state, total = np.zeros(len(by), np.int64), np.zeros(len(by))
        alive = np.searchsorted(-size, -np.arange(size[0]) if len(size) else np.empty(0, int), "left")
        for t, m in enumerate(alive):
            word = words[begin[:m] + t]
            counts = (skip[:m] <= t).astype(float)
            todo = np.arange(m)
            while len(todo):
                s = state[todo]
                root = s == 0
                if root.any():
                    there = todo[root]
                    total[there] += self.root_score[word[there]] * counts[there]
                    state[there] = self.root_next[word[there]]
                    todo, s = todo[~root], s[~root]
                    if not len(todo):
                        break
                want = s * self.words + word[todo]
                at = np.searchsorted(self.key[: self.arcs], want)
                hit = self.key[at] == want
                there, arc = todo[hit], at[hit]
                total[there] += self.score[arc] * counts[there]
                state[there] = self.next[arc]
                todo, s = todo[~hit], s[~hit]
                total[todo] += self.weight[s] * counts[todo]
                state[todo] = self.fail[s]
        return np.bincount(owner, weights=total, minlength=len(n))


def score_texts(docs: DataFrame, train: Column, text: str = "text", keys: tuple[str, ...] = ("doc_id",), order: int = ORDER, shard_bytes: int = SHARD_BYTES, fan: int = exchange.FAN) -> DataFrame:
    """`keys`, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    `train` says which rows the counts come from (null: no). A null text is empty and has the end
    token alone; an empty table gives an empty result; a text of any length is scored whole, by one
    shard. Repeated rows count, and are scored, each. With no training rows every token is unknown
    and the only certain event, so all scores are 0. Word identity is a 64-bit hash; longer n-grams
    are told apart by as many bits as the corpus has bytes, and 22 more, so that one of them is
    taken for another with a probability below 2^-22 at any size.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(12, math.ceil(size / shard_bytes))
    drop = max(0, 64 - SPARE_BITS - (size + 2).bit_length())
    own = docs.select(F.pmod(F.xxhash64(*keys, text), F.lit(shards)).cast("long").alias("shard"), F.struct(*keys).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text")).repartition(min(shards, PARTITIONS), "shard")
    by_shard = own.groupBy("shard")

    def parsed(table: pa.Table, upto: int) -> tuple[Grams, list[np.ndarray]]:
        grams = shard_grams(table.combine_chunks()["text"].chunk(0), upto, drop)
        return grams, local_counts(grams, np.repeat(table["train"].to_numpy(), np.diff(grams.first)))

    def ask(table: pa.Table) -> pa.Table:
        grams, local = parsed(table, min(order, 2))
        shard = table["shard"][0].as_py()
        return exchange.request_table([r for k, (names, n) in enumerate(zip(grams.keys, local)) for r in exchange.requests(shard, k, names, 2 * n, shards, fan, drop if k else 0)])

    def ask_more(k: int):
        def asking(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return exchange.request_table([])
            grams, local = parsed(table, k + 1)
            some = shared(grams, all_totals(grams, local, replies, k)[1], k)
            return exchange.request_table(exchange.requests(table["shard"][0].as_py(), k, grams.keys[k][some], 2 * local[k][some], shards, fan, drop))

        return asking

    # One plan from here on: the texts are shuffled once, for asking and for scoring.
    answered = exchange.total_counts(by_shard.applyInArrow(ask, exchange.REQUEST), shards, fan)
    sums = answered.where("unit < 0 and kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "types", "once", "twice")])
    replies_ = answered.where("unit >= 0")
    for k in range(2, order):
        more = by_shard.cogroup(replies_.groupBy("unit")).applyInArrow(ask_more(k), exchange.REQUEST)
        replies_ = replies_.union(exchange.total_counts(more, shards, fan).where("unit >= 0"))
    everywhere = sums.select(F.lit(0).cast("long").alias("prefix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("unit"), F.lit(0).alias("part"), F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("counts"), "total", "types", "once", "twice")

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not table.num_rows:
            return pa.table([table["key"], pa.array([], pa.bool_()), *[pa.array([], pa.int64())] * 3, *[pa.array([], pa.float64())] * 2], names=names)
        grams, local = parsed(table, order)
        (whole,) = np.flatnonzero(replies["kind"].to_numpy() < 0)
        tokens, types, once, twice = (replies[c][int(whole)].as_py() for c in ("total", "types", "once", "twice"))
        totals, _ = all_totals(grams, local, replies, order)
        word = grams.number[0]
        known = (totals[0] > 0).astype(np.int64)
        base = np.log10((totals[0] + 1) / (tokens + types + 1))
        walked = Automaton(grams, totals, tokens, types, once, twice).walk(word, grams.first)
        add = lambda x: np.add.reduceat(x[word], grams.first[:-1])
        return pa.table([table["key"], pa.array(~table["train"].to_numpy()), pa.array(np.diff(grams.first)), pa.array(add(known)), pa.array(np.full(len(table), tokens)), pa.array(add(base)), pa.array(walked)],
                        names=names)

    scored = by_shard.cogroup(replies_.union(everywhere).groupBy("unit")).applyInArrow(
        score, with_key(own.schema["key"].dataType, "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    return scored.select("key.*", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def crc_split(key: str = "doc_id", parts: int = 7, held_out: int = 2) -> Column:
    """Training rows: those whose key's CRC-32 as text (null: as '') has another remainder than `held_out`."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts != held_out
