"""Recall of the approximate search on rows of the tables themselves, and queries in blocks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.operators import vector_search as vs
from mediaframe.queries import QUERIES


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_ten_on_table_rows(spark, sf):
    got = QUERIES["n3_parity"](spark, f"/root/testdata/{sf}")
    n, mean = got.agg(F.count("*"), F.avg("recall")).first()
    assert n == spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert mean >= 0.9


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, v, kind="float"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")


def test_blocks_of_queries(spark):
    df = table(spark, np.random.default_rng(5).standard_normal((60, 8)), "double")
    q = df.withColumnRenamed("vec_id", "query_id")
    whole, index = rows(vs.search_exact(df, q, 3)), vs.build_index(df)
    assert len(whole) == 180 and rows(vs.search_exact(df, q, 3, max_queries=7)) == whole
    assert rows(vs.search_ann(df, q, 3, index, max_queries=7)) == rows(vs.search_ann(df, q, 3, index))
    index.probes = len(index.sizes)  # all cells: the exact search
    assert rows(vs.search_ann(df, q, 3, index)) == whole


def test_vectors_in_clusters_are_mostly_not_scored(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((40, 16))[r.integers(0, 40, 3000)] * 3 + r.standard_normal((3000, 16)) * 0.5
    v[1000:2000] = v[7]  # a third are copies
    df, q = table(spark, v), table(spark, v).where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = vs.build_index(df)
    unit = vs._unit(q.toPandas()["embedding"])
    assert index.sizes.sum() == 3000 and index.scored(unit) < 0.25 * len(unit) * 3000 + 21 * 1000
    exact, near = vs.search_exact(df, q, 10), vs.search_ann(df, q, 10, index)
    assert vs.parity(exact, near, 10).agg(F.avg("recall")).first()[0] >= 0.9
    both = exact.join(near.withColumnRenamed("score", "s"), ["query_id", "vec_id"])
    assert both.where("score <> s").count() == 0  # scores are exact


def test_indexes_of_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [0.0, 2.0])], "vec_id long, embedding array<float>")
    q = some.withColumnRenamed("vec_id", "query_id")
    assert vs.search_ann(none, q, 3).count() == 0 and vs.search_ann(some, none.withColumnRenamed("vec_id", "query_id"), 3).count() == 0
    index = vs.build_index(some)
    index.probes = len(index.sizes)
    assert rows(vs.search_ann(some, q.where("query_id in (2, 4)"), 3, index)) == [(2, 2, 1.0, 1), (2, 4, 0.0, 2), (4, 2, 0.0, 2), (4, 4, 1.0, 1)]
    assert vs.search_ann(some, q.where("query_id = 1"), 3, index).count() == 0
