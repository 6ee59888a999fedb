"""Streams against their batch twins."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediaframe.sources import catalog
from mediaframe.sources.buckets import BucketStore, Unstable
from mediaframe.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, tmp_path, rows, schema, batches=2):
    """Rows as files read one a micro-batch."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


MEDIA = "media_id string, content_revision long, access_epoch long"


def test_ingest_keeps_the_highest_revision_and_a_fresh_checkpoint_loses_nothing(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "out"), buckets=4)
    stream = feed(spark, tmp_path, [("a", 2, 1), ("b", 1, 1), ("a", 1, 1), ("b", 3, 1)], MEDIA)
    jobs.stream_ingest(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert {r.media_id: r.content_revision for r in store.read().collect()} == {"a": 2, "b": 3}
    jobs.stream_ingest(stream, store, str(tmp_path / "cp")).awaitTermination()  # nothing new
    number, pointer = store.pointers.last()
    assert number == 2 and list(pointer["writers"].values()) == [1]
    (tmp_path / "more").mkdir()
    second = feed(spark, tmp_path / "more", [(f"c{i}", 1, 1) for i in range(10)], MEDIA)
    jobs.stream_ingest(second, store, str(tmp_path / "fresh")).awaitTermination()
    assert store.read().count() == 12 and len(store.pointers.last()[1]["writers"]) == 2


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "out"), buckets=32, keep=2)
    store.fold(spark.range(3000).selectExpr("'m' || id AS media_id", "1L AS content_revision", "1L AS access_epoch"), jobs.latest_revisions, "s", 0)
    before = store.pointers.last()[1]["buckets"]
    assert len(before) == 32
    one = spark.createDataFrame([("m7", 2, 1)], MEDIA)
    assert store.fold(one, jobs.latest_revisions, "s", 1) and not store.fold(one, jobs.latest_revisions, "s", 1)
    after = store.pointers.last()[1]["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1
    assert store.read().count() == 3000 and store.read().where("content_revision = 2").count() == 1
    for k in range(2, 5):
        store.fold(spark.createDataFrame([("m7", k + 1, 1)], MEDIA), jobs.latest_revisions, "s", k)
    assert len(store.pointers.numbers()) == 2 and store.read().count() == 3000
    kept = {v for n in store.pointers.numbers() for v in store.pointers.read(n)["buckets"].values()}
    there = {f"data/{f}/{p}" for f in store.pointers.names(f"{store.path}/data") for p in store.pointers.names(f"{store.path}/data/{f}") if p.startswith("_bucket")}
    assert there == kept
    assert not store.fold(spark.createDataFrame([], MEDIA), jobs.latest_revisions, "s", 4)


def test_of_two_writers_one_starts_again(spark, tmp_path):
    one, two = (BucketStore(spark, str(tmp_path / "out"), buckets=2) for _ in range(2))
    first = one.stage(spark.createDataFrame([("a", 1, 1)], MEDIA), jobs.latest_revisions)
    two.upsert(spark.createDataFrame([("b", 1, 1)], MEDIA))
    assert not one.commit(first)
    one.discard(first)
    assert one.fold(spark.createDataFrame([("a", 1, 1)], MEDIA), jobs.latest_revisions)
    assert {r.media_id for r in two.read().collect()} == {"a", "b"}
    with pytest.raises(Unstable):
        one.fold(spark.createDataFrame([("c", 1, 1)], MEDIA), jobs.latest_revisions, seen=lambda _: two.upsert(spark.createDataFrame([("d", 1, 1)], MEDIA)))
    assert {r.media_id for r in two.read().collect()} == {"a", "b", "d"}


def test_an_unstable_scan_leaves_no_trace(spark, tmp_path):
    store, tick = BucketStore(spark, str(tmp_path / "out"), buckets=2), iter(range(100))
    moving = lambda: spark.createDataFrame([("v", "1", next(tick))], "volume string, version string, generation long")
    batch = spark.createDataFrame([("a", 1, 1)], MEDIA)
    with pytest.raises(Unstable):
        store.scan(moving, lambda _: batch, jobs.latest_revisions)
    assert store.pointers.numbers() == [] and store.pointers.names(f"{store.path}/data") == []
    with pytest.raises(FileNotFoundError):
        store.read()
    steps = iter([1, 2, 3, 3])
    assert store.scan(lambda: spark.createDataFrame([("v", "1", next(steps))], "volume string, version string, generation long"), lambda _: batch, jobs.latest_revisions) == 2
    assert store.read().count() == 1


def test_revision_counts_only_listed_changes(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "state"), buckets=3)
    stream = feed(spark, tmp_path, [("a", 1, 1, "x"), ("b", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 1, 1, "z")], MEDIA + ", note string")
    jobs.stream_revision(stream, store, str(tmp_path / "changes"), ["content_revision"], str(tmp_path / "cp")).awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "changes")).orderBy("batch").collect()
    assert [r.changes for r in changes] in ([2, 1], [1, 2], [3, 0], [2, 0]) and sum(r.changes for r in changes) == 3
    batch = spark.createDataFrame([("a", 9, 1, "x")], MEDIA + ", note string")
    assert jobs.fold_counting(batch, store, str(tmp_path / "more"), ["content_revision"], "s", 0) and not jobs.fold_counting(batch, store, str(tmp_path / "more"), ["content_revision"], "s", 0)
    assert [(r.batch, r.changes) for r in spark.read.parquet(str(tmp_path / "more")).collect()] == [(0, 1)]


def test_epochs_equal_batch_though_rows_come_late(spark, tmp_path):
    states = ["AVAILABLE", "MISSING", "AVAILABLE", "AVAILABLE", "INACCESSIBLE", "MISSING", "AVAILABLE"]
    rows = [(m, i * 2 + k, s, at(i)) for i, s in enumerate(states) for k, m in enumerate("ab")]
    late = rows[:2] + rows[6:8] + rows[2:6] + rows[10:] + rows[8:10] + [("z", 0, "AVAILABLE", at(90_000)), ("z", 1, "AVAILABLE", at(180_000)), ("z", 2, "AVAILABLE", at(270_000)), ("z", 3, "AVAILABLE", at(360_000))]
    schema = "media_id string, n long, availability string, at timestamp"
    got = [r for r in run(jobs.stream_epochs(feed(spark, tmp_path, late, schema, 6)), tmp_path, "epochs").collect() if r.media_id != "z"]
    want = jobs.epochs_batch(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) == 14


def test_bursts_and_periods_equal_batch(spark, tmp_path):
    rows = [(i % 2, at(x)) for i, x in enumerate([0, 0, 0.1, 0.1, 0.3, 1, 90_000, 90_000.2, 300_000, 300_000])]
    schema = "volume int, ts timestamp"
    stream = feed(spark, tmp_path, rows, schema)
    got = run(jobs.bursts(stream, keys=("volume",)), tmp_path, "bursts").collect()
    want = jobs.bursts(spark.createDataFrame(rows, schema), keys=("volume",)).collect()
    assert {(r.volume, r.started, r.events) for r in got} == {(r.volume, r.started, r.events) for r in want if r.started < at(200_000)}
    live = run(jobs.live_periods(stream), tmp_path, "periods", "update").groupBy("day_key").agg(F.max("items").alias("n")).collect()
    assert {(r.day_key, r.n) for r in live} == {(r.day_key, r["items"]) for r in jobs.live_periods(spark.createDataFrame(rows, schema)).collect()}


def test_dedup(spark, tmp_path):
    rows = [("x", at(0)), ("y", at(1)), ("x", at(2)), ("z", at(3))]
    got = run(jobs.stream_dedup(feed(spark, tmp_path, rows, "sha string, ts timestamp"), "sha"), tmp_path, "dedup")
    assert sorted(r.sha for r in got.collect()) == ["x", "y", "z"]


def test_a_late_trashing_does_not_expire_what_was_restored(spark, tmp_path):
    day = 86_400
    rows = [("a", "AVAILABLE", at(1800)), ("k", "AVAILABLE", at(1801)), ("a", "TRASHED", at(0)), ("k", "AVAILABLE", at(1802)), ("b", "TRASHED", at(1803)), ("k", "AVAILABLE", at(1804)), ("z", "AVAILABLE", at(40 * day)), ("z", "AVAILABLE", at(41 * day)), ("z", "AVAILABLE", at(42 * day)), ("z", "AVAILABLE", at(43 * day))]
    schema = "media_id string, availability string, ts timestamp"
    got = run(jobs.stream_retention(feed(spark, tmp_path, rows, schema, 5)), tmp_path, "late_trash")
    want = jobs.retention_batch(spark.createDataFrame(rows, schema), int(at(43 * day).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and [r.media_id for r in want.collect()] == ["b"]


def test_retention_timer(spark, tmp_path):
    day = 86_400
    rows = [("a", "TRASHED", at(0)), ("b", "TRASHED", at(0)), ("b", "AVAILABLE", at(day)), ("c", "AVAILABLE", at(day)), ("d", "AVAILABLE", at(40 * day)), ("e", "AVAILABLE", at(41 * day))]
    got = run(jobs.stream_retention(feed(spark, tmp_path, rows, "media_id string, availability string, ts timestamp", 3)), tmp_path, "retention")
    assert [r.media_id for r in got.collect()] == ["a"]


def test_results_are_held_against_the_rows_of_their_moment(spark, tmp_path):
    schema, path = MEDIA + ", score double", str(tmp_path / "live")
    catalog.publish(spark.createDataFrame([("a", 2, 1)], MEDIA), path, "g1")
    stream = feed(spark, tmp_path, [("a", 2, 1, 0.1), ("a", 1, 1, 0.2), ("a", 2, 1, 0.3), ("a", 3, 1, 0.4)], schema)
    batches = []

    def live():
        if batches:  # revised between the two batches
            catalog.publish(spark.createDataFrame([("a", 3, 1)], MEDIA), path, "g2")
        batches.append(1)
        return catalog.read_published(spark, path)

    jobs.stream_publish(stream, live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    first = {r.batch: set() for r in got}
    for r in got:
        first[r.batch].add(r.content_revision)
    assert len(batches) == 2 and first == {0: {2}, 1: {3}} or sorted(r.score for r in got) in ([0.1, 0.4], [0.3, 0.4])


@pytest.mark.parametrize("keys", [(), ("volume",)])
def test_bursts_of_a_table_equal_a_walk(spark, keys):
    r = random.Random(8)
    times, t = [], 0.0
    for _ in range(800):
        t += r.choice([0, 0, 0.1, 0.25, 0.26, 0.2, 3])
        times.append((r.randrange(2), round(t, 3)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = jobs.bursts(spark.createDataFrame([(v, at(x)) for v, x in times] + [(1, None)], "volume int, ts timestamp"), keys=keys).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for v in {v for v, _ in times} if keys else {None}:
        last = None
        for x in sorted(x for w, x in times if v is None or w == v):
            if last is None or round(x - last, 3) > 0.25:
                want.append([v, x, x, 0])
            want[-1][2:] = [x, want[-1][3] + 1]
            last = x
    assert sorted((r[0] if keys else None, r.started, r.ended, r.events) for r in got) == sorted((v, at(a), at(b) + dt.timedelta(milliseconds=250), n) for v, a, b, n in want) if keys else \
        sorted((r.started, r.ended, r.events) for r in got) == sorted((at(a), at(b) + dt.timedelta(milliseconds=250), n) for _, a, b, n in want)


def test_file_inventory_and_publish(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name in ("a" * 64 + ".image", "b" * 63 + ".image", "c" * 64 + ".txt"):
        (tmp_path / "f" / name).write_bytes(b"12345")
    assert [(r.sha, r.size) for r in catalog.file_inventory(spark, str(tmp_path / "f")).collect()] == [("a" * 64, 5)]
    df = spark.range(3)
    for g in ("g1", "g2"):
        catalog.publish(df, str(tmp_path / "p"), g)
        df = df.limit(1)
    assert catalog.read_published(spark, str(tmp_path / "p")).count() == 1


def test_eval_dataset(spark, tmp_path):
    from mediaframe.operators.evaluate import read_eval_dataset

    (tmp_path / "d.json").write_text('{"photos": [{"id": "p", "size": 3}],\n "queries": [{"id": "q", "language": "en", "relevant": ["p"]}]}')
    tables = read_eval_dataset(spark, str(tmp_path / "d.json"))
    assert sorted(tables) == ["photos", "queries"] and tables["photos"].first().id == "p"
