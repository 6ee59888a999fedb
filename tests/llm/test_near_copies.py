"""Near copies against brute-force Jaccard, in small tiles and bands too."""
import random
import re

import numpy as np
import pyarrow as pa

from mediaframe.llm import near_copies, simhash
from tests.llm.fixtures import documents, texts
from tests.llm.test_simhash import fingerprint


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def groups(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similar(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def copies():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(30):
        w = [word() for _ in range(r.randint(60, 300))]
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 4):  # more and more changed words, some under the similarity
            v = list(w)
            for _ in range(max(1, len(w) * k * r.choice([1, 2]) // 150)):
                v[r.randrange(len(v))] = word()
            rows.append((10 * i + k, " ".join(v)))
    return rows


def test_one_of_each_group_of_jaccard_copies(spark):
    rows = copies()
    group = groups(rows)
    want = sorted({g: min(i for (i, _), h in zip(rows, group) if h == g) for g in group}.values())
    assert 30 < len(want) < 110
    prints = {i: fingerprint(t) for i, t in rows}
    assert sum((prints[10 * i] ^ prints[10 * i + 1]).bit_count() > 2 for i in range(30)) > 20
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()) == want


def test_awkward_texts_in_small_tiles(spark):
    rows = list(enumerate(texts())) + copies()[:40]
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(200, rows[0][1])]
    group = groups(rows)
    want = sorted((i, min(k for (k, _), h in zip(rows, group) if h == g)) for (i, _), g in zip(rows, group))
    got = near_copies.near_copies(documents(spark, rows).withColumnRenamed("key", "_other"), "text", "doc_id", tile=2)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == want


def test_shingle_sets_of_short_and_empty_texts():
    column = pa.array(["a b c d e f", None, "A b", "a  b", "", "x x x x x x x"])
    values, first = near_copies.shingle_sets(column)
    assert np.diff(first).tolist() == [2, 0, 1, 1, 0, 1]
    names = near_copies.set_names(values, first)
    assert names[2] == names[3] and names[1] == names[4] == 0 and len(set(names.tolist())) == 4
