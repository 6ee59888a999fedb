"""Near pairs by both ways, and relations where a hash or a content is crowded, against brute force."""
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.operators import dedup


def hashes(n, seed, planted=60):
    r = random.Random(seed)
    out = [r.getrandbits(63) for _ in range(n)] + [0, (1 << 63) - 1, 7]
    for _ in range(planted):
        v = r.choice(out)
        for i in r.sample(range(63), r.choice([1, 4, 9, 13, 14, 15, 16])):
            v ^= 1 << i
        out.append(v)
    return out


@pytest.mark.parametrize("options", [{}, {"tile": 100}, {"most_in_tiles": 0}, {"most_in_tiles": 0, "tile": 3}])
def test_near_pairs_equal_brute_force(spark, options):
    values = sorted(set(hashes(400, 1)))
    got = dedup.near_pairs(spark.createDataFrame([(i, v) for i, v in enumerate(values + values[:9])] + [(99, None)], "id long, bits long"), **options).collect()
    want = {(a, b): (a ^ b).bit_count() for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 14}
    assert len(got) == len(want) and {(r.left_bits, r.right_bits): r.distance for r in got} == want and len(want) > 40


def test_blocks_meet_once(spark):
    """Hashes of one block only, where every pair is close in the other two."""
    values = [v << 21 for v in (0, 1, 3, 7, 15, 31, 63)]
    got = dedup.near_pairs(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, bits long"), most_in_tiles=0)
    assert got.count() == 21 == got.distinct().count()


def test_few_pairs_are_looked_at(spark):
    """The share of all pairs that reach a value together, for hashes of no structure."""
    n = 3000
    b = np.random.default_rng(2).integers(0, 1 << 63, n)
    met = dedup._meetings(spark.createDataFrame([(int(x),) for x in b], "b long"), 4, dedup.TILE)
    looked = met.groupBy("block", "value").agg((F.count("*") * (F.count("*") - 1) / 2).alias("p")).agg(F.sum("p")).first()[0]
    assert looked < 0.05 * 2 * n * (n - 1) / 2  # a pair may meet at several values; 1 % of pairs do at all
    close = sum((np.bitwise_count((x >> s & dedup.MASK) ^ (b >> s & dedup.MASK)) <= 4).sum() - 1 for x in b[:200] for s in (0, 21, 42)) / (200 * n)
    assert close < 0.05


def related(rows, top=8, distance=14):
    out = []
    for i, s, b in rows:
        near = sorted(((b ^ c).bit_count(), j) for j, t, c in rows if j > i and t != s and (b ^ c).bit_count() <= distance)
        out += [(i, j, d) for d, j in near[:top]]
    return sorted(out)


@pytest.mark.parametrize("seed,width", [(3, 64), (4, 5), (5, 1), (6, 1000)])
def test_relations_equal_brute_force(spark, seed, width):
    r = random.Random(seed)
    pool = hashes(12, seed, 12)
    rows = [(i * 3, f"s{r.choice([0, 0, 0, 1, 2, i])}", r.choice(pool[:3] + pool)) for i in range(300)]
    r.shuffle(rows)
    got = dedup.relations(spark.createDataFrame(rows, "id long, sha string, bits long"), width=width)
    assert sorted(map(tuple, got.collect())) == related(rows)


def test_a_crowd_of_copies_is_not_multiplied_out(spark):
    """50,000 items of one hash, half of them of one content: time and rows stay in proportion."""
    n = 50_000
    crowd = spark.range(n).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'copy' ELSE CAST(id AS STRING) END AS sha", "5L AS bits").union(spark.createDataFrame([(n + 1, "near", 4), (n + 2, "far", (1 << 63) - 1)], "id long, sha string, bits long"))
    began = time.time()
    got = dedup.relations(crowd).groupBy("left_id").agg(F.count("*").alias("n"), F.min("right_id").alias("a"), F.max("right_id").alias("b")).collect()
    assert time.time() - began < 90
    by = {r.left_id: (r.n, r.a, r.b) for r in got}
    assert by[0] == (8, 1, 15) and by[1] == (8, 2, 9) and by[n - 1] == (1, n + 1, n + 1) and by[40_000] == (8, 40_001, 40_015)


def test_relations_of_strings_and_empty_tables(spark):
    rows = spark.createDataFrame([("b", "x", 1), ("a", "y", 0), ("c", "x", None)], "id string, sha string, bits long")
    assert [tuple(r) for r in dedup.relations(rows).collect()] == [("a", "b", 1)]
    assert dedup.relations(rows.limit(0)).count() == 0


def test_hashes_of_texts(spark):
    words = " ".join(f"w{i}" for i in range(300))
    got = [r.b for r in spark.createDataFrame([(words,), (words + " tail",), ("",), (None,), ("one",)], "t string").select(dedup.text_hash("t").alias("b")).collect()]
    assert (got[0] ^ got[1]).bit_count() <= 6 and got[2:] == [0, None, 0] and 0 < got[0] < 1 << 60
