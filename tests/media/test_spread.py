"""Tables dealt out before heavy work, and text hashes against their definition."""
import hashlib
import re

import pandas as pd

from mediaframe.operators.dedup import text_hash
from mediaframe.plans.lineage import spread

TEXTS = [None, "", " ", "a", " a  b\n", "\t\v\f\r\n", "é x y é x", "a b c", "one two three two three", "w " * 5000 + "x", "a b", "a b"]


def slow_hash(text):
    if text is None:
        return None
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    each = [f"{int(hashlib.md5(f'{a} {b}'.encode()).hexdigest(), 16):0128b}"[:60] for a, b in zip(w, w[1:])]
    return sum(1 << (59 - i) for i in range(60) if 2 * sum(h[i] == "1" for h in each) > len(each)) if each else 0


def test_text_hash_equals_its_definition(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: r.h for r in rows.select("id", text_hash("text").alias("h")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [slow_hash(t) for t in TEXTS]
    assert text_hash.func(pd.Series([], dtype=object)).empty


def test_spread_deals_small_tables_only(spark):
    wanted = spark.sparkContext.defaultParallelism
    one = spark.range(1000).coalesce(1)
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() == wanted
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    many = spark.range(0, 1000, 1, wanted + 3)
    assert spread(many) is many
    assert spread(one.where("id < 0")).count() == 0
