"""Ranks when one group holds everything: the order itself cuts it into parts."""
import random

import pytest
from pyspark.sql import functions as F

from mediaframe.functions.time import with_periods
from mediaframe.operators import generation as gen, timeline as tl
from mediaframe.plans.rank import ordered_rank


def crowd(spark, n=6000, taken="CAST(NULL AS TIMESTAMP_NTZ)"):
    return with_periods(spark.range(n).selectExpr("'m' || lpad(id * 7919 % 6007, 6, '0') AS media_id", f"{taken} AS taken_at", "CAST(NULL AS TIMESTAMP_NTZ) AS added_at"))


@pytest.fixture(autouse=True)
def small_partitions_stay(spark):
    """Tables as small as these would else be joined into one partition."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_undated_rows_alone_are_ranked_in_many_tasks(spark):
    v = crowd(spark)
    ranked = tl.feed_rank(v)
    assert [r.media_id for r in ranked.orderBy("rank").collect()] == sorted((r.media_id for r in v.collect()), reverse=True)
    assert largest_share(ranked) < 0.5
    day = tl.day_position(v)
    assert {(r.day_size, r.day_key) for r in day.select("day_size", "day_key").distinct().collect()} == {(6000, "undated")}
    assert [r.day_position for r in day.orderBy("day_position").collect()] == list(range(6000))


def test_one_year_with_everything(spark):
    v = crowd(spark, taken="CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ)")
    ids = sorted(r.media_id for r in v.collect())
    assert [(r.place, r.media_id) for r in tl.samples(v, "year").orderBy("place").collect()] == [(0, ids[0]), (2999, ids[2999]), (5999, ids[5999])]
    keyed = ordered_rank(v, [F.col("media_id")], "place", [F.col("year_key")])
    assert largest_share(keyed) < 0.5


def test_places_and_sizes_inside_groups_with_nulls(spark):
    r = random.Random(5)
    rows = [(r.choice([None, "a", "b", "c"]), i) for i in range(500)]
    got = ordered_rank(spark.createDataFrame(rows, "g string, i long").repartition(7), [F.col("i").desc()], "place", [F.col("g")], "n")
    for g in (None, "a", "b", "c"):
        ids = sorted((i for h, i in rows if h == g), reverse=True)
        assert sorted((x.place, x.i, x.n) for x in got.collect() if x.g == g) == [(k, i, len(ids)) for k, i in enumerate(ids)]
    assert ordered_rank(spark.createDataFrame([], "g string, i long"), [F.col("i")], group=[F.col("g")]).count() == 0


def test_keys_go_on_from_the_largest(spark):
    new, none = spark.createDataFrame([("c",), ("a",), ("b",)], "media_id string"), spark.createDataFrame([], "native_key long")
    keys = lambda old: [(r.media_id, r.native_key) for r in gen.append_keys(new, old, F.col("media_id")).orderBy("native_key").collect()]
    assert keys(none) == [("a", 1), ("b", 2), ("c", 3)]
    assert keys(spark.createDataFrame([(4,), (9,)], "native_key long")) == [("a", 10), ("b", 11), ("c", 12)]
