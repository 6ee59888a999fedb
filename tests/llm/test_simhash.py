import random
import re

import numpy as np
import xxhash

from mediaframe.llm import simhash
from tests.llm.fixtures import documents


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, radius=2):
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fp = [fingerprint(t) for _, t in rows]
    group = components(fp)
    least = {g: min([rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None], default=None) for g in group}
    want = sorted((str(i), f"{f:016x}", str(least[g])) for (i, _), f, g in zip(rows, fp, group))
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want


def test_links_connect_what_brute_force_connects_even_in_small_tiles(spark):
    r = random.Random(1)
    values = {r.getrandbits(64) for _ in range(80)} | {0, (1 << 64) - 1}
    for v in list(values)[:40]:
        for _ in range(4):
            v ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    links = [(int(np.int64(x.a).view(np.uint64)), int(np.int64(x.b).view(np.uint64))) for x in simhash.fingerprint_links(df, 2, tile=8).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    group = {v: v for v in values}
    for a, b in links:
        if group[a] != group[b]:
            old, new = group[a], group[b]
            group = {k: new if g == old else g for k, g in group.items()}
    want = components(values)
    pairs = {(group[v], w) for v, w in zip(values, want)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_keep_one(spark):
    docs = documents(spark, [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "quite another text is here today"), (None, None), (None, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.key) for r in kept.collect()) == [("2", "kept"), ("9", "kept"), ("None", "kept")]
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_majority_bits_long_runs():
    h = np.random.default_rng(0).integers(0, 1 << 63, 700_000, dtype=np.uint64)
    first = np.array([0, 0, 600_000, 600_001, 700_000, 700_000])
    want = [0 if a == b else sum(1 << i for i in range(64) if 2 * int((h[a:b] >> np.uint64(i) & np.uint64(1)).sum()) > b - a) for a, b in zip(first, first[1:])]
    assert simhash.majority_bits(h, first).tolist() == want
