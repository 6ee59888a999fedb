"""Faults that only tables of some size show, on small tables that have what the size brings."""
import glob
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import text
from mediaframe.operators import dedup, evaluate, generation as gen, tokens
from mediaframe.plans.lineage import shared_folder
from mediaframe.queries import QUERIES


def test_digest_of_hashes_whose_sum_passes_a_long(spark):
    n = 70_000
    rows = spark.range(n, numPartitions=2).select(F.col("id").alias("native_key"), F.lit("m").alias("media_id"), F.lit(1).alias("content_revision"), F.lit(2).alias("access_epoch"))
    got = gen.membership_digest(rows).first()
    h = [int(hashlib.sha256(f"{i}|m|1|2".encode()).hexdigest()[:12], 16) for i in range(n)]
    assert (got.n_rows, got.sum) == (n, str(sum(h))) and sum(h) >= 1 << 63


def faces(spark, tmp_path):
    """Detections of which some share an anchor: vec_ids that are 100,003 apart."""
    ids = [*range(60), *range(100_003, 100_063)]
    spark.createDataFrame([(i, [1.0], i // 15 % 3) for i in ids], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    return ids


def test_edits_of_detections_that_share_an_anchor(spark, tmp_path):
    ids = faces(spark, tmp_path)
    got = QUERIES["f5_apply_edits"](spark, str(tmp_path)).collect()
    anchor = lambda i: f"f{i * 7919 % 100003:06d}"
    want = [(anchor(i), "EXCLUDE", None) if i % 3 == 0 else (anchor(i), "ASSIGN", f"p{i % 4}") for i in ids if i % 15]
    assert sorted(map(str, want)) == sorted(str((r.anchor_id, r.decision, r.person_id)) for r in got)


def test_pairs_of_detections_that_share_anchors(spark, tmp_path):
    ids = set(faces(spark, tmp_path))
    got = QUERIES["j16_cannot_link_pairs"](spark, str(tmp_path)).collect()
    anchor = lambda i: f"f{i * 7919 % 100003:06d}"
    want = {tuple(sorted((anchor(i), anchor(i + 10)))) for i in ids if i + 10 in ids and i % 5 == 0 and i // 15 % 3 == (i + 10) // 15 % 3}
    assert sorted((r.a, r.b) for r in got) == sorted(want) and want


def test_datasets_are_written_by_many_tasks(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(glob.glob(f"{at(spark)}/dataset-*"))
    assert QUERIES["s10_eval_dataset"](spark, str(tmp_path)).distinct().count() == 3000
    (path,) = set(glob.glob(f"{at(spark)}/dataset-*")) - before
    files = [f.split("part-")[1] for f in glob.glob(f"{path}/part-*")]
    tasks = [f[:5] for f in files]
    assert len(files) == 30 and max(map(tasks.count, tasks)) < 15


def at(spark):
    return shared_folder(spark).removeprefix("file:")


@pytest.mark.parametrize("shift", [0, 21])
def test_hashes_meet_by_parts_as_all_with_all(shift):
    """Two tiles of 2,200 hashes, beyond the size up to which all meet; some in crowds around one hash, some that agree in most parts."""
    r = np.random.default_rng(3)
    b = r.integers(0, 1 << 63, 4400 - 600) >> shift << shift
    flips = np.array([np.bitwise_or.reduce(1 << r.choice(63, k, replace=False)) for k in r.integers(1, 18, 600)])
    b = np.unique(np.concatenate([b, b[r.integers(0, 5, 600)] ^ flips]))
    r.shuffle(b)
    left, right = b[: len(b) // 2], b[len(b) // 2 :]
    got = [(i, j, d) for x in dedup._close(left, right, 14) for i, j, d in zip(*map(np.ndarray.tolist, x))]
    distance = np.bitwise_count(left[:, None] ^ right)
    i, j = np.nonzero(distance <= 14)
    assert sorted(got) == list(zip(i.tolist(), j.tolist(), distance[i, j].tolist())) and len(got) > 100
    assert shift or sum(dedup._by_part(left, right, *p, 2)[0] for p in dedup.PARTS) < 0.3 * len(left) * len(right)


def test_pairs_of_tiles_are_tasks_of_their_own(spark):
    """Few bytes are much work: partitions must not be put together by their size."""
    dealt = dedup._tiles(spark.range(20_000).select(F.xxhash64("id").alias("b")), 20_000, 1 << 17)
    assert dealt.select("t1", "t2", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().agg(F.max("count")).first()[0] < 6
    assert dealt.rdd.getNumPartitions() == 72


def test_words_walk_some_at_a_time(spark):
    docs = spark.createDataFrame([(i, "en", ["ab"] * (i % 5) + ["x"]) for i in range(40)], "doc_id long, lang string, w array<string>").coalesce(1)
    walk = lambda n: sorted(map(tuple, tokens._walked(docs, tokens.Trie.of(["a", "b"]), n).collect()))
    assert walk(1) == walk(7) == walk(1 << 18) == [(i, "en", 2 * (i % 5) + 1, i % 5 + 1, 1) for i in range(40)]


def test_a_batch_of_texts_does_not_stand_in_python(spark):
    """Texts of a batch are taken one by one: what Python allocates stays far under the batch."""
    batch = pa.array(["e\u0301" * 5000] * 400)
    for f, args in ((text._nfc, (batch,)), (evaluate.text_distance, (batch, batch))):
        tracemalloc.start()
        out = f.func(*args)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == 400 and peak < batch.nbytes / 4
    assert text._nfc.func(batch)[0].as_py() == "\u00e9" * 5000 and evaluate.text_distance.func(batch, pa.array([None] * 400, pa.string())).null_count == 400
