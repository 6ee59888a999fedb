"""Resampling, exact dedup and ranked search against brute force, with nulls, repeats, ties, long texts and clashing columns."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql.types import LongType

from mediaframe.llm import exact_dedup, lexical_search, slices, target_resampling
from tests.llm.fixtures import WORDS, documents, texts


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def items(spark, rows=None):
    rows = [(7, "alpha beta gamma delta"), (8, None), (9, ""), (10, "Éclair naïve of ß the the"), (10, "theta"), (11, "nowhere else"), (None, "zeta x y")] if rows is None else rows
    return spark.createDataFrame([(i, t, 1.0) for i, t in rows], "item_id long, text string, score double")


# --- hashes of slices ---------------------------------------------------------------------------
def test_hashes_of_slices():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(9000)) + bytes(8)
    start = np.array([r.randrange(8000) for _ in range(6000)])
    end = start + np.array([r.choice([*range(0, 20), *range(70), 900]) for _ in start])
    for seed in (0, 42):
        assert slices.xxh64_slices(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(start, end)]
    assert slices.crc32_slices(data, start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
    other = start.copy()
    other[::2] += 1
    assert slices.equal_slices(data, start, other, end - start).tolist() == [data[a:b] == data[c : c + b - a] for a, b, c in zip(start, end, other)]


def test_colliding_keys_are_told_apart_by_their_bytes():
    data = b"abcabdabc" + bytes(8)
    start, end = np.array([0, 3, 6, 0, 1]), np.array([3, 6, 9, 2, 3])
    same = target_resampling.intern(data, start, end, np.full(5, 77, np.uint64), 10_000)
    assert same.of[0] == same.of[2] and len(set(same.of.tolist())) == 4
    assert same.count[same.of].tolist() == [2, 1, 2, 1, 1]
    assert same.bucket[same.of].tolist() == [zlib.crc32(data[a:b]) % 10_000 for a, b in zip(start, end)]


# --- resampling ---------------------------------------------------------------------------------
def features(text):
    w = alnum(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent):
    s, t = (Counter(b for x in rows for b in features(x)) for rows in ([d for _, d in docs], target))
    big_s, big_t = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10_000)]
    out = []
    for i, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(alnum(x)) >= 20])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("percent", [5, 40])
def test_resampling_equals_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(target_resampling, "CHUNK", 50)  # the driver's copy; tasks use their own, texts() holds one of 5000 words
    docs, target = documents(spark), items(spark)
    got = target_resampling.resample(docs, target, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    drawn = {(i, x) for (i, x), r in zip([(r.doc_id, r.text) for r in docs.collect()], want) if r[4]}
    rows = target_resampling.drawn_documents(docs, target, percent=percent)
    assert rows.columns == docs.columns and {(r.doc_id, r.text) for r in rows.collect()} == drawn


def test_chunks_of_words_make_no_difference(monkeypatch):
    column = pa.array([t for t in texts()])
    whole = [(s.count.sum(), sorted(zip(of.tolist(), s.bucket[s.of].tolist()))) for s, of in target_resampling.interned(column, 3, 10_000)[1]]
    monkeypatch.setattr(target_resampling, "CHUNK", 37)
    parts = [(s.count.sum(), list(zip(of.tolist(), s.bucket[s.of].tolist()))) for s, of in target_resampling.interned(column, 3, 10_000)[1]]
    assert len(whole) == 1 < len(parts)
    assert whole[0][0] == sum(n for n, _ in parts) and whole[0][1] == sorted(x for _, p in parts for x in p)


def test_resampling_of_empty_tables_and_repeated_rows(spark):
    none = documents(spark, [])
    assert target_resampling.resample(none, items(spark)).count() == 0
    text = " ".join(str(i) for i in range(30))
    many = target_resampling.resample(documents(spark, [(4, text)] * 40 + [(None, text)]), items(spark, []))
    got = [tuple(r) for r in many.collect()]
    assert sorted(r[4] for r in got if r[4]) == [1, 2] and {r[1] for r in got} == {87}


# --- exact dedup --------------------------------------------------------------------------------
@pytest.fixture
def index(spark, tmp_path):
    return exact_dedup.DigestIndex(spark, f"file://{tmp_path}/digests", LongType(), 6)


def test_exact_dedup_equals_brute_force(spark, index):
    docs = documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    largest = {}
    for i, t in rows:
        largest[t] = i if t not in largest or largest[t] is None else max(largest[t], -1 if i is None else i)
    got = exact_dedup.deduplicate(docs, index)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = [tuple(r) for r in got.collect()]
    want = [(i, largest[t], sum(u == t for _, u in rows), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted(map(str, ((a, b, c, e) for a, b, c, _, e in got))) == sorted(map(str, want))
    kept = [r for r in got if r[3]]
    assert len(kept) == len(largest) == len({r[4] for r in kept}) and all(r[0] == r[1] for r in kept)


def test_later_batches_meet_the_index_and_a_replay_changes_nothing(spark, index):
    first = documents(spark, [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None)])
    second = documents(spark, [(9, "a"), (2, "a"), (10, "c"), (11, "c"), (12, "")])
    kept = lambda docs: sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.deduplicate(docs, index).collect())
    one = kept(first)
    assert one == [(1, 2, False), (2, 2, True), (3, 3, False), (3, 3, True), (4, 4, True)] and kept(first) == one
    assert kept(second) == [(2, 2, True), (9, 2, False), (10, 11, False), (11, 11, True), (12, 4, False)]
    assert sorted((bytes(r.digest).hex(), r.keep_id) for r in index.table().collect()) == sorted((hashlib.sha256(t.encode()).hexdigest(), i) for t, i in (("a", 2), ("b", 3), ("", 4), ("c", 11)))
    again = exact_dedup.DigestIndex(spark, index.path, LongType(), 6)
    rows = exact_dedup.new_documents(documents(spark, [(20, "a"), (21, "d"), (21, "d")]), again)
    assert rows.columns == first.columns and [(r.doc_id, r.text) for r in rows.collect()] == [(21, "d")]
    assert exact_dedup.deduplicate(documents(spark, []), index).count() == 0


def test_the_index_side_of_the_anti_join_is_not_shuffled(spark, index):
    exact_dedup.deduplicate(documents(spark), index).count()
    groups = exact_dedup.digest_rows(documents(spark)).groupBy("digest").count()
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the batch's


# --- ranked search ------------------------------------------------------------------------------
def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def ranked(docs, queries, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted, out = {}, []
    for i, t in queries:
        wanted.setdefault(i, set()).update(terms(t))
    for i, words in wanted.items():
        found = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("width,first,most,queries", [(8192, 50, 1000, 512), (16, 2, 1000, 512), (64, 1, 1, 2), (1, 1, 0, 1)])
def test_ranked_search_equals_brute_force(spark, width, first, most, queries):
    r = random.Random(7)
    docs = documents(spark).union(documents(spark, [(1000 + i, " ".join(r.choice(WORDS) + r.choice("123 ") for _ in range(r.choice([3, 30, 300])))) for i in range(80)] + [(2000 + i, "alpha beta gamma delta") for i in range(15)]))
    asked = items(spark)
    got = lexical_search.rank_documents(docs, asked, width=width, first=first, max_broadcast=most, max_queries=queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str((x.item_id, x.rank, x.doc_id, x.score)) for x in got.collect()) == ranked([(x.doc_id, x.text) for x in docs.collect()], [(x.item_id, x.text) for x in asked.collect()])


def test_bounds_hold_and_an_index_outlives_other_statistics(spark):
    column = pa.array(texts() + ["word " * 400])
    n, _, term, _ = lexical_search.term_counts(column)
    q = lexical_search.Queries([0, 1], np.unique(term), np.repeat([0, 1], len(np.unique(term))), np.tile(np.arange(len(np.unique(term))), 2), np.arange(1, len(np.unique(term)) + 1))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(column.to_pylist())], "doc_id long, text string")
    rows = lexical_search.build_index(docs, width=8).orderBy("key").collect()
    for documents_, total in ((int((n > 0).sum()), int(n.sum())), (1000, 77_777)):
        bound = lexical_search.upper_bounds(np.array([x.n for x in rows]), pa.array([bytes(x["at"]) for x in rows]), pa.array([bytes(x.most) for x in rows]), lexical_search.lookup(q, 8), documents_, total)
        exact = lexical_search.exact_scores(column.take(pa.array([x["key"] for x in rows])), q, documents_, total)
        assert (bound >= exact).all() and len(rows) == (n > 0).sum()


def test_searches_of_empty_tables(spark):
    assert lexical_search.rank_documents(documents(spark, []), items(spark)).count() == 0
    assert lexical_search.rank_documents(documents(spark, [(1, None), (2, "...")]), items(spark)).count() == 0
    assert lexical_search.rank_documents(documents(spark), items(spark, [])).count() == 0
