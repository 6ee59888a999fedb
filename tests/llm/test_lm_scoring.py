import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mediaframe.llm import exchange, lm_scoring
from tests.llm.fixtures import documents


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute(rows, order):
    grams = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            for k in range(1, order + 1):
                grams[k].update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    n, v = sum(grams[1].values()), len(grams[1])
    once, twice = (sum(c == x for c in grams[1].values()) for x in (1, 2))
    d = min(once / (once + 2 * twice), 0.95) if once else 0.5
    heaps = math.log(v) / math.log(n)
    weight = lambda c: 1 / (1 + c ** (1 - heaps))

    def p(gram):
        if len(gram) == 1:
            c = grams[1][gram]
            return (c - d) / n if c else d * v / n
        c = grams[len(gram) - 1][gram[:-1]]
        if not c:
            return p(gram[1:])
        return (1 - weight(c)) * grams[len(gram)][gram] / c + weight(c) * p(gram[1:])

    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((grams[1][(x,)] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p(tuple(w[max(0, a - order + 1) : a + 1]))) for a in range(len(w)))
        out.append((i, held(i), len(w), sum(grams[1][(x,)] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return out, p, grams


@pytest.mark.parametrize("order, fan", [(1, 1024), (2, 1024), (3, 1024), (4, 1024), (2, 3), (3, 2)])
def test_scores_equal_brute_force(spark, order, fan):
    """A small fan has the twelve shards merged on several levels."""
    docs = documents(spark)
    got = lm_scoring.score_texts(docs, lm_scoring.crc_split(), order=order, fan=fan)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want, p, grams = brute([(r.doc_id, r.text) for r in docs.collect()], order)
    key = lambda r: tuple(map(str, r))
    assert sorted([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in got.collect()], key=key) == sorted(want, key=key)
    if order > 1:  # the probabilities after a context add to one, the unseen word included
        for context in list(grams[order - 1])[:5]:
            if context[-1] is not None:
                assert sum(p((*context, w)) for (w,) in grams[1]) + p((*context, "never-seen")) == pytest.approx(1)


def test_empty_table_and_no_training_rows(spark):
    docs = documents(spark, [])
    assert lm_scoring.score_texts(docs, lm_scoring.crc_split()).count() == 0
    one = documents(spark, [(next(i for i in range(99) if held(i)), "a b")])
    row = lm_scoring.score_texts(one, lm_scoring.crc_split()).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_segments_leave_scores_alone():
    column = pa.array([" ".join(w for w in ("abcab" * 40)), "a b", None, "c a b " * 33])
    grams = lm_scoring.shard_grams(column, 3)
    local = lm_scoring.local_counts(grams, np.ones(grams.first[-1], bool))
    machine = lm_scoring.Automaton(grams, local, int(local[0].sum()), len(local[0]), 1, 1)
    whole = machine.walk(grams.number[0], grams.first, 10_000)
    for segment in (1, 2, 7, 64):
        assert machine.walk(grams.number[0], grams.first, segment) == pytest.approx(whole, rel=1e-12)
    assert (machine.fail[1 + len(local[0]) :] > 0).all()  # two-word states fail to one-word states


def test_packed_keys_and_ranges():
    r = np.random.default_rng(3)
    for n, drop in ((1, 0), (2, 5), (1000, 0), (1000, 14)):
        keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(drop) << np.uint64(drop))
        assert (exchange.unpack_keys(exchange.pack_keys(keys, drop), len(keys))[0] == keys).all()
        rows = exchange.requests(5, 1, keys, np.arange(len(keys)), 10**6, 7, drop, 3, (7, 4))
        assert sum(x[4] for x in rows) == len(keys) and all(x[:2] == (3, 5) for x in rows)
    counts = np.array([0, 1, 255, 256, 70000, 2**33])
    assert (exchange.unpack_counts(exchange.pack_counts(counts)) == counts).all()


def test_very_long_text(spark):
    long = " ".join(f"w{i * i % 50021}" for i in range(3_000_000))  # about 19 MB
    rows = [(i, t) for i, t in ((0, long), (1, "w1 w4 w9"), (3, None))]
    got = {x.doc_id: x for x in lm_scoring.score_texts(documents(spark, rows), lm_scoring.crc_split()).collect()}
    assert got[0].n_tokens == 3_000_001 and got[3].n_tokens == 1 and all(x.score < 0 for x in got.values())
