import random
import re
from collections import Counter

import numpy as np
import pytest

from mediaframe.llm import fm_index, substring_dedup
from tests.llm.fixtures import documents, texts


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((str(key), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def passages():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(4000)}"
    shared = [[word() for _ in range(r.randint(6, 90))] for _ in range(6)]
    out = []
    for _ in range(80):
        body = [word() for _ in range(r.randint(0, 150))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(body))
            p = r.choice(shared)
            body[at:at] = p[r.randint(0, 3) : len(p) - r.randint(0, 3)]
        out.append(" ".join(body))
    return out + ["a b " * 60, "c " * 50, out[3], out[3], None, ""] + texts()


@pytest.mark.parametrize("window,run,hot,fan", [(35, 12, 2000, 1024), (8, 3, 2000, 1024), (8, 3, 2, 1024), (5, 5, 1, 1024), (8, 3, 2, 3)])
def test_removal_equals_brute_force(spark, window, run, hot, fan):
    rows = list(enumerate(passages())) + [(3, "again an old id"), (None, None)]
    docs = documents(spark, rows)
    got = substring_dedup.remove_repeats(docs, window=window, run=run, hot=hot, shard_bytes=4000, fan=fan)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute(rows, window)


def test_drop_repeats_keeps_rows_and_columns(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(1, f"a\nb {long}"), (2, f"{long} c"), (3, "left\nas it is"), (4, None)]
    docs = documents(spark, rows)
    got = substring_dedup.drop_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b"), (2, "c"), (3, "left\nas it is"), (4, None)]
    assert substring_dedup.drop_repeats(documents(spark, [])).count() == 0


def test_very_long_texts(spark):
    a, b = (" ".join(f"{k}{i * i % 900_007}" for i in range(1_500_000)) for k in "xy")  # about 10 MB each
    rows = [(1, a + " " + " ".join(f"z{i}" for i in range(40))), (2, " ".join(f"z{i}" for i in range(40)) + " " + b), (3, "c")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    want = {k: (n, gone) for k, n, gone, _ in brute(rows, 35)}
    assert {str(k): (r.n_words, r.n_removed) for k, r in got.items()} == want and got[1].n_removed >= 40


def test_fm_index_counts():
    r = np.random.default_rng(4)
    parts = [r.integers(1, 6, r.integers(3, 12)) for _ in range(30)]
    weight = r.integers(1, 4, 30)
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = fm_index.FMIndex(text, np.repeat(weight, [len(p) + 1 for p in parts]), 13)

    def count(pattern):
        return sum(w for p, w in zip(parts, weight) for i in range(len(p) - len(pattern) + 1) if (p[i : i + len(pattern)] == pattern).all())

    begin = np.cumsum([0, *[len(p) + 1 for p in parts]])[:-1]
    high = begin + [len(p) for p in parts]
    for least in (1, 3, 9):
        got = index.shortest_begin(text, begin, high, least)
        want = []
        for lo, hi in zip(begin, high):
            f = hi
            while f > lo and count(text[f - 1 : hi]) >= least:
                f -= 1
            want.append(f)
        assert got.tolist() == want
    tree = fm_index.WaveletTree(text, 6)
    at = np.arange(len(text) + 1)
    for s in range(6):
        assert tree.rank(np.full(len(at), s), at).tolist() == [int((text[:i] == s).sum()) for i in at]
