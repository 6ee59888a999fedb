"""Repeated passages found with an FM-index per shard of routed segments.

A window belongs to the segment of consecutive windows that share their minimizer, the least
hash among their inner word runs. Equal windows have equal minimizers, so routing segments by
minimizer brings every place of a window to one index, and only minimizers seen twice are sent.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm import exchange
from mediaframe.llm.arrays import Words, join_hash, mix, split_words
from mediaframe.llm.fm_index import FMIndex
from mediaframe.llm.sqltext import with_key

WINDOW, RUN, HOT, SHARD_BYTES = 35, 12, 2000, 4 << 20
PARTITIONS = 50_000  # of the text shuffle at most; a partition then holds several shards, taken one after the other


class Segments:
    """Windows of a shard's texts grouped by minimizer.

    begin, windows: first word and number of windows of each segment; name: minimizer hash;
    same: number of each segment's distinct content; lead: a segment with that content.
    """

    def __init__(self, words: Words, window: int, run: int):
        h, n = words.hash, len(words.hash)
        ends = np.repeat(words.first[1:], words.count())
        self.window, self.total = window, n
        starts = np.flatnonzero(np.arange(n) + window <= ends)
        runs = run_hashes(h, run)
        least, place = _least_of(runs, window - run + 1)
        at, name = place[starts], mix(least[starts])  # least hashes are small; mixed ones spread over all ranges
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        cut = np.flatnonzero(new)
        self.begin, self.name = starts[cut], name[cut]
        self.windows = np.diff(np.append(cut, len(starts)))
        self.full = run_hashes(h, window)  # of each window, for crowded minimizers

    def contents(self, h: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen segments: a segment of each distinct content, and the number of each one's content.

        A segment's words are told by its first and last window and its length, since its windows overlap.
        """
        begin, windows = self.begin[chosen], self.windows[chosen]
        key = join_hash(join_hash(self.full[begin], self.full[begin + windows - 1]), windows.astype(np.uint64) + _spread(h, begin, begin + windows + self.window - 1))
        _, lead, same = np.unique(key, return_index=True, return_inverse=True)
        return chosen[lead], same


def _spread(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order-sensitive sums over word ranges."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * (h >> np.uint64(7) | np.uint64(1)), dtype=np.uint64)])
    return sums[end] - sums[begin]


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on (as far as they exist), by doubling."""
    out, width, power = None, 0, h
    bit = 1
    while bit <= size:
        if size & bit:
            out, width = (power, bit) if out is None else (join_hash(out[: max(0, len(h) - width - bit + 1)], power[width:][: max(0, len(h) - width - bit + 1)]), width + bit)
        power = join_hash(power[: max(0, len(power) - bit)], power[bit:])
        bit *= 2
    return out


def _least_of(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of the `span` values from each place on, and its leftmost place."""
    best, place, width = values.copy(), np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        other, where = best[step:], place[step:]
        best, place = best[: len(other)].copy(), place[: len(other)].copy()
        less = other < best
        best[less], place[less] = other[less], where[less]
        width += step
    return best, place


def _slices(keys: np.ndarray, n: int):
    """(range, first, end) of the `n` equal ranges that hold any of the sorted keys."""
    half = np.uint64(32)
    part = ((keys >> half) * np.uint64(n)) >> half
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else [0]
    return ((int(part[lo]), lo, hi) for lo, hi in zip(cuts, cuts[1:]))


def repeated_windows(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, weight: np.ndarray, window: int) -> list[np.ndarray]:
    """(segment, first, last): runs of windows that occur twice or more, by backward search.

    `text` joins distinct segments, each ended by 0, with words numbered from 1; segments start
    at `begin` and have so many windows; `weight` is how often each segment stands in the corpus.
    A search ends at the last word of one window and goes left through the windows before it: what
    it matches twice marks windows, what it cannot match rules out all that contain it, and the
    windows left on either side are searched in turn.
    """
    size = windows + window - 1
    index = FMIndex(text, np.repeat(weight, size + 1), int(size.max()) + 1)
    seg, a, b, out = np.arange(len(begin)), np.zeros(len(begin), np.int64), windows - 1, []
    probe = b
    while len(seg):
        base = begin[seg]
        f = index.shortest_begin(text, base + a, base + probe + window, 2) - base
        marked = f <= probe
        out.append(np.stack([seg[marked], f[marked], probe[marked]]))
        left = np.stack([seg, a, np.minimum(f, probe) - 1])
        right = np.stack([seg, np.maximum(probe, f - 1) + 1, b])
        seg, a, b = (todo := np.concatenate([left, right], axis=1))[:, todo[1] <= todo[2]]
        probe = (a + b) // 2
    return out


def remove_repeats(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), window: int = WINDOW, run: int = RUN, hot: int = HOT, shard_bytes: int = SHARD_BYTES, fan: int = exchange.FAN, unchanged_as_is: bool = False) -> DataFrame:
    """`keys`, n_words, n_removed, kept (the words left, joined by one space); one row per input row.

    Every word inside a window of `window` words that also starts anywhere else, in any row or the
    same one, goes. Null texts have no words; an empty table gives an empty result; repeated rows
    remove each other's windows; texts of any length are taken whole. With `unchanged_as_is` a text that loses nothing is
    returned as it was. A minimizer of more than `hot` segments would crowd
    one index: its windows are first counted one by one and only repeated ones are sent, each to
    the index of its own hash, equal ones once a shard. Words are told apart by 64-bit hashes.
    """
    if window - min(run, window) >= 64:
        raise ValueError("a segment's windows must fit 64 bits: take a longer run")
    bytes_ = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(12, math.ceil(bytes_ / shard_bytes))
    own = docs.select(F.pmod(F.xxhash64(*keys, text), F.lit(shards)).cast("long").alias("shard"), F.struct(*keys).alias("key"), F.col(text).alias("text")).repartition(min(shards, PARTITIONS), "shard")

    def parse(table: pa.Table) -> tuple[Words, Segments]:
        words = split_words(table.combine_chunks()["text"].chunk(0))
        return words, Segments(words, window, min(run, window))

    def requests(table: pa.Table, names: np.ndarray, kind: int) -> pa.Table:
        unique, counts = np.unique(names, return_counts=True)
        return exchange.request_table(exchange.requests(table["shard"][0].as_py(), kind, unique, 2 * counts, shards, fan))

    def ask(table: pa.Table) -> pa.Table:
        return requests(table, parse(table)[1].name, 0)

    def names_of(s: Segments, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The shard's minimizers that stand twice or more: those of few segments, and the crowded ones."""
        unique, (total, _) = np.unique(s.name), exchange.totals_of(replies, 0)
        return unique[(total >= 2) & (total <= hot)], unique[total > hot]

    def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values if len(of) else np.zeros(len(values), bool)

    def singles(s: Segments, chosen: np.ndarray) -> np.ndarray:
        """Starts of all windows of the chosen segments."""
        n = s.windows[chosen]
        return np.repeat(s.begin[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def ask_again(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.request_table([])
        _, s = parse(table)
        return requests(table, s.full[singles(s, np.flatnonzero(member(s.name, names_of(s, replies)[1])))], 1)

    def to_send(s: Segments, h: np.ndarray, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contents to send (first word, windows, routing hash, how many), and then, for each place, its first word and content's number."""
        plain, crowded = names_of(s, replies)
        chosen = np.flatnonzero(member(s.name, plain))
        lead, same = s.contents(h, chosen)
        begin, windows, route, place = s.begin[lead], s.windows[lead], s.name[lead], s.begin[chosen]
        if len(crowded):
            at = singles(s, np.flatnonzero(member(s.name, crowded)))
            twice = np.unique(s.full[at])[exchange.totals_of(replies, 1)[0] >= 2]
            at = at[member(s.full[at], twice)]
            hashes, first, number = np.unique(s.full[at], return_index=True, return_inverse=True)
            same, place = np.concatenate([same, len(lead) + number]), np.concatenate([place, at])
            begin, windows, route = np.concatenate([begin, at[first]]), np.concatenate([windows, np.ones(len(first), np.int64)]), np.concatenate([route, hashes])
        return begin, windows, route, place, same

    sending = "bucket int, shard long, numbers binary, windows binary, weights binary, vocabulary binary, words binary"

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and replies.num_rows:
            words, s = parse(table)
            begin, windows, route, _, same = to_send(s, words.hash, replies)
            weight = np.bincount(same, minlength=len(begin))
            order = np.argsort(route, kind="stable")
            for b, lo, hi in _slices(route[order], shards):
                ids = order[lo:hi]
                size = windows[ids] + window - 1
                at = np.repeat(begin[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
                vocabulary, number = np.unique(words.hash[at], return_inverse=True)
                rows.append((b, table["shard"][0].as_py(), ids.astype("<u4").tobytes(), windows[ids].astype("<u2").tobytes(), np.minimum(weight[ids], 2**31).astype("<u4").tobytes(), vocabulary.tobytes(), number.astype("<u4" if len(vocabulary) > 65535 else "<u2").tobytes()))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "shard", "numbers", "windows", "weights", "vocabulary", "words"])

    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        windows = [np.frombuffer(r["windows"], "<u2").astype(np.int64) for r in rows]
        parts = [np.frombuffer(r["vocabulary"], "<u8")[np.frombuffer(r["words"], "<u4" if len(r["vocabulary"]) > 8 * 65535 else "<u2")] for r in rows]
        _, word = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.concatenate(windows)
        size = count + window - 1
        first = np.cumsum(size) - size
        # Equal contents from several shards stand in the index once, with their weights added.
        place = np.arange(len(word)) - np.repeat(first, size)
        content = join_hash(np.add.reduceat(_mixed(word, place), first), size.astype(np.uint64))
        _, lead, same = np.unique(content, return_index=True, return_inverse=True)
        weight = np.bincount(same, weights=np.concatenate([np.frombuffer(r["weights"], "<u4") for r in rows])).astype(np.int64)
        n = size[lead]
        at = np.repeat(first[lead] - np.cumsum(n) + n, n) + np.arange(n.sum())
        begin = np.cumsum(n + 1) - (n + 1)
        text = np.zeros(int((n + 1).sum()), np.int64)
        text[np.arange(len(at)) + np.repeat(np.arange(len(n)), n)] = word[at] + 1
        marks = np.zeros(len(lead), np.uint64)
        for seg, lo, hi in repeated_windows(text, begin, count[lead], weight, window):
            np.bitwise_or.at(marks, seg, _bits(lo, hi))
        out, at = [], 0
        for r, w in zip(rows, windows):
            m = marks[same[at : at + len(w)]]
            at += len(w)
            if m.any():
                out.append((r["shard"], np.frombuffer(r["numbers"], "<u4")[m > 0].tobytes(), m[m > 0].tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["shard", "numbers", "marks"])

    def keep(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Replies are the totals (kind 0 and 1) and, as kind 2, the marks."""
        if not table.num_rows:
            return pa.table([table["key"], pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["key", "n_words", "n_removed", "kept"])
        words, s = parse(table)
        gone = np.zeros(len(words.hash) + 1, np.int64)
        marked = [r for r in replies.select(["kind", "counts", "marks"]).to_pylist() if r["kind"] == 2]
        if marked:
            begin, _, _, place, same = to_send(s, words.hash, replies)
            marks = np.zeros(len(begin), np.uint64)
            for r in marked:
                marks[np.frombuffer(r["counts"], "<u4")] = np.frombuffer(r["marks"], "<u8")
            for i in range(64):
                at = place[(marks[same] >> np.uint64(i) & np.uint64(1)) == 1] + i
                gone += np.bincount(at, minlength=len(gone)) - np.bincount(np.minimum(at + window, len(gone) - 1), minlength=len(gone))
        stays = np.cumsum(gone)[:-1] == 0
        removed = np.diff(np.concatenate([[0], np.cumsum(~stays)])[words.first])
        kept = _joined(words, stays)
        if unchanged_as_is:
            kept = pc.if_else(pa.array(removed > 0), kept, table.combine_chunks()["text"].chunk(0).cast(pa.string()))
        return pa.table([table["key"], pa.array(words.count()), pa.array(removed), kept], names=["key", "n_words", "n_removed", "kept"])

    by, to = own.groupBy("shard"), (lambda df: df.groupBy("unit"))
    first = exchange.total_counts(by.applyInArrow(ask, exchange.REQUEST), shards, fan).where("unit >= 0")
    second = exchange.total_counts(by.cogroup(to(first)).applyInArrow(ask_again, exchange.REQUEST), shards, fan).where("unit >= 0")
    replies = first.union(second).select("unit", "kind", "part", "counts", F.lit(None).cast("binary").alias("marks"))
    marks = by.cogroup(to(replies)).applyInArrow(send, sending).groupBy("bucket").applyInArrow(search, "shard long, numbers binary, marks binary")
    all_ = replies.union(marks.select(F.col("shard").alias("unit"), F.lit(2).alias("kind"), F.lit(0).alias("part"), F.col("numbers").alias("counts"), "marks"))
    return by.cogroup(to(all_)).applyInArrow(keep, with_key(own.schema["key"].dataType, "n_words long, n_removed long, kept string")).select("key.*", "n_words", "n_removed", "kept")


def drop_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """`docs`, all rows and columns, with texts that `remove_repeats` changes replaced by the words left.

    `n_chars`, where there is such a column, follows the text. Null texts stay null.
    """
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    left = remove_repeats(docs.select(rest.alias("_rest"), F.col(text).alias("_text")), "_text", ("_rest",), window, unchanged_as_is=True, **options)
    length = lambda c: F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(F.col(f"_rest.`{c}`"))
    return left.select(*[(F.col("kept") if c == text else length(c) if c == "n_chars" else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])


def _mixed(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    return join_hash(word.astype(np.uint64) + np.uint64(1), place.astype(np.uint64))


def _bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits lo to hi of a 64-bit value."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return (full >> (np.uint64(63) - (hi - lo).astype(np.uint64))) << lo.astype(np.uint64)


def _joined(words: Words, stays: np.ndarray) -> pa.Array:
    """The staying words of each text, joined by one space."""
    size = np.where(stays, words.end - words.start + 1, 0)
    text = words.text_of()
    total = np.bincount(text, weights=size, minlength=len(words.first) - 1).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(total - 1, 0))])
    n = size[stays]
    at = np.repeat(words.start[stays] - np.cumsum(n) + n, n) + np.arange(n.sum())
    out = words.data[np.minimum(at, len(words.data) - 1)] if len(at) else np.empty(0, np.uint8)
    ends = np.cumsum(n) - 1
    out[ends] = 32
    last = np.zeros(len(out), bool)
    last[np.cumsum(total)[total > 0] - 1] = True
    out = out[~last]
    return pa.LargeStringArray.from_buffers(len(total), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())
