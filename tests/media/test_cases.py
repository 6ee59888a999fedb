"""Small cases with known results."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import numbers as nx
from mediaframe.functions.text import contains_literal, ocr_normalize, ocr_search_key, search_key
from mediaframe.functions.time import exif_instant, with_periods
from mediaframe.operators import dedup, evaluate as ev, fence, lifecycle as life, people, policy, search, timeline as tl, vector_search as vs
from mediaframe.operators.generation import copy_forward, mark_absent, reconcile_scan
from mediaframe.operators.tokens import tokenize_corpus
from mediaframe.plans.graph import connected_components


def day(s):
    return dt.datetime.fromisoformat(s) if s else None


def media(spark, rows):
    """(id, taken, added)"""
    return spark.createDataFrame([(i, day(a), day(b)) for i, a, b in rows], "media_id string, taken_at timestamp_ntz, added_at timestamp_ntz")


def test_fallback_dates_and_undated_last(spark):
    v = with_periods(media(spark, [("taken", "2020-04-03", "2026-01-01"), ("fallback", None, "2021-05-04"), ("a", None, None), ("b", None, None)]))
    assert [r.media_id for r in tl.feed_rank(v).orderBy("rank").collect()] == ["fallback", "taken", "b", "a"]
    assert {r.day_key for r in tl.day_headers(v).collect()} == {"2021-05-04", "2020-04-03", "undated"}
    n = {r.media_id: (r.previous_id, r.next_id) for r in tl.neighbours(v).collect()}
    assert n["taken"] == ("fallback", "b") and n["fallback"] == (None, "taken") and n["a"] == ("b", None)


def test_weeks_over_the_year(spark):
    v = with_periods(media(spark, [("a", "2026-01-04", None), ("b", "2025-12-29", None), ("c", "2026-01-05", None)]))
    assert {(r.key, r["items"]) for r in tl.period_summary(v, ("week",)).collect()} == {("2025-12-29", 2), ("2026-01-05", 1)}
    sunday = with_periods(media(spark, [("a", "2026-01-04", None), ("c", "2026-01-05", None)]), week_start=6)
    assert {r.week_key for r in sunday.collect()} == {"2026-01-04"}


def test_library_zone_moves_the_day(spark):
    v = with_periods(media(spark, [("a", "2026-03-15T23:30:00", None)]), zone="Europe/Madrid")
    assert v.first().day_key == "2026-03-16"


def test_samples(spark):
    v = with_periods(media(spark, [(f"p{i}", f"2026-03-0{i}", None) for i in range(1, 6)]))
    assert [r.media_id for r in tl.samples(v, "month").orderBy("place").collect()] == ["p1", "p3", "p5"]


def test_period_rank(spark):
    v = with_periods(media(spark, [("a", "2026-03-15", None), ("b", "2026-03-01", None), ("c", "2026-02-01", None)]))
    anchors = spark.createDataFrame([("2026-03",), ("2026-02",)], "key string")
    assert {(r.key, r.newer) for r in tl.period_rank(v, "month", anchors).collect()} == {("2026-03", 0), ("2026-02", 1)}


@pytest.mark.parametrize("n", [2_000, 20_000, 100_000])
def test_scale_invariants(spark, n):
    v = with_periods(spark.range(n).selectExpr("lpad(id, 9, '0') AS media_id", "CASE WHEN id % 17 <> 0 THEN CAST(timestamp_seconds(1600000000 + id * 997) AS TIMESTAMP_NTZ) END AS taken_at", "CAST(NULL AS TIMESTAMP_NTZ) AS added_at"))
    assert tl.period_summary(v).groupBy("level").agg(F.sum("items").alias("s")).where(F.col("s") != n).count() == 0
    assert tl.covers(v, "month").groupBy("key").count().where("count > 3").count() == 0
    r = tl.feed_rank(v).agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(r) == (0, n - 1, n)


def test_no_window_over_all_rows_and_no_cross_product(spark):
    v = with_periods(media(spark, [("a", "2026-03-15", None)]))
    for df in (tl.neighbours(v), dedup.near_pairs(spark.createDataFrame([(1, 2)], "id long, bits long"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan and "Join Cross" not in plan


def test_exif_dates(spark):
    rows = [("2026:10:25 02:30:00", None), ("2026:10:25 02:30:00", "+01:00"), ("garbage", None), ("2026:13:45 99:00:00", None), (None, "+01:00")]
    df = spark.createDataFrame(rows, "t string, o string").select(F.unix_millis(exif_instant(F.col("t"), F.col("o"), "Europe/Madrid")).alias("m"))
    assert [r.m for r in df.collect()] == [1792888200000, 1792891800000 - 0, None, None, None]


def test_text_keys(spark):
    raw = "  Ёлка\nCafé  42  "
    r = spark.createDataFrame([(raw,), (None,)], "t string").select(ocr_normalize(F.col("t")), ocr_search_key(F.col("t")), search_key(F.col("t"))).collect()
    assert r[0][:2] == ("Ёлка\nCafé 42", "ёлка café 42") and tuple(r[1]) == (None, None, None)
    names = spark.createDataFrame([("100%_СНИМОК.jpg",), ("100xСНИМОК.jpg",)], "n string")
    assert names.where(contains_literal(search_key(F.col("n")), "%_снимок")).count() == 1


def _luma(spark, images):
    return [r.h for r in spark.createDataFrame([(i, x.astype(int).ravel().tolist(), x.shape[1], x.shape[0]) for i, x in enumerate(images)], "i int, l array<int>, w int, h0 int").select("i", dedup.dct_hash("l", "w", "h0").alias("h")).orderBy("i").collect()]


def test_perceptual_hash(spark):
    y, x = np.mgrid[0:40, 0:48]
    base = (x * 3 + y * 2) % 256
    a, brighter, board = _luma(spark, [base, np.minimum(base + 12, 255), ((x // 4 + y // 4) % 2) * 255])
    distance = lambda p, q: (p ^ q).bit_count()
    assert distance(a, brighter) <= 14 < distance(a, board)


def test_bands_never_lose_a_near_pair(spark):
    far = (1 << 63) - 1
    fourteen = sum(1 << (4 * i) for i in range(14))
    bytes_ = sum(1 << (8 * i) for i in range(8)) & far
    df = spark.createDataFrame([(0, 0), (1, fourteen), (2, bytes_), (3, far)], "id long, bits long")
    got = {(r.left_bits, r.right_bits, r.distance) for r in dedup.near_pairs(df).collect()}
    assert (0, fourteen, 14) in got and (0, bytes_, 8) in got and not any(r[1] == far and r[0] == 0 for r in got)


def test_face_clusters_and_people(spark):
    rows = [(0, "d1", "a", [1.0, 0.0]), (0, "d2", "b", [0.99, 0.01]), (0, "d3", "c", [0.0, 1.0])]
    faces = spark.createDataFrame(rows, "chunk long, detection_id string, anchor_id string, embedding array<double>")
    none = people.keep_apart(spark.createDataFrame([], "a string, b string"))
    got = {r.anchor_id: r.cluster_id for r in people.cluster_faces(faces, none, 0.9).collect()}
    assert got == {"a": "auto:a", "b": "auto:a", "c": "auto:c"}
    apart = spark.createDataFrame([("b", "a")], "a string, b string")
    assert len({r.cluster_id for r in people.cluster_faces(faces, people.keep_apart(apart), 0.9).collect()}) == 3
    one = spark.createDataFrame([("d1", "a", "k"), ("d2", "b", "k"), ("d3", "c", "k")], "detection_id string, anchor_id string, computed_cluster_id string")
    decisions = spark.createDataFrame([("a", "ASSIGN", "person-1"), ("b", "EXCLUDE", None)], "anchor_id string, decision string, person_id string")
    merges = spark.createDataFrame([], "from_person_id string, into_person_id string")
    res = {r.anchor_id: (r.person_id, r.excluded) for r in people.resolve_people(one, decisions, merges).collect()}
    assert res["c"] == ("person-1", False) and res["b"][1] and res["a"] == ("person-1", False)
    with pytest.raises(ValueError):
        people.canonical(spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p")], "from_person_id string, into_person_id string"))
    chain = spark.createDataFrame([(f"p{i:03}", f"p{i + 1:03}") for i in range(40)], "from_person_id string, into_person_id string")
    assert {r.root for r in people.canonical(chain).collect()} == {"p040"}


def test_scan_marks_missing_and_epochs(spark):
    m = spark.createDataFrame([("1", "DEVICE", "v", "AVAILABLE"), ("2", "DEVICE", "v", "AVAILABLE")], "media_id string, source string, volume_name string, availability string")
    volumes = spark.createDataFrame([("v", True)], "volume_name string, same_version boolean")
    assert {r.media_id: r.availability for r in mark_absent(m, m.where("media_id = '2'"), volumes, True).collect()} == {"1": "MISSING", "2": "AVAILABLE"}
    assert {r.media_id: r.availability for r in mark_absent(m, m.where("media_id = '2'"), volumes, False).collect()}["1"] == "INACCESSIBLE"
    kind = "media_id string, content_revision long, availability string, access_epoch long, taken_at timestamp_ntz, added_at timestamp_ntz, exif_taken_at timestamp_ntz"
    old = spark.createDataFrame([("1", 1, "MISSING", 4, None, None, day("2001-01-01"))], kind)
    new = spark.createDataFrame([("1", 1, "AVAILABLE", 0, day("2020-01-01"), None, None), ("2", 1, "AVAILABLE", 0, None, None, None)], kind)
    got = {r.media_id: (r.access_epoch, r.day_key) for r in reconcile_scan(old, new).collect()}
    assert got == {"1": (5, "2001-01-01"), "2": (1, "undated")}


def test_copy_forward_and_fence(spark):
    live = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "media_id string, content_revision long, access_epoch long")
    rows = spark.createDataFrame([("g1", "a", 1, 1), ("g1", "b", 1, 1)], "generation_id string, media_id string, content_revision long, access_epoch long")
    assert [(r.media_id, r.generation_id) for r in copy_forward(rows, live, "g2").collect()] == [("a", "g2")]
    assert fence.stale(rows, live).count() == 1


def test_retention_is_inclusive(spark):
    m = spark.createDataFrame([("a", "TRASHED", day("2026-01-01")), ("b", "TRASHED", day("2026-01-01T00:00:01"))], "media_id string, availability string, trashed_at timestamp_ntz")
    assert {r.media_id: r.availability for r in life.expire(m, "2026-01-31 00:00:00").collect()} == {"a": "PURGING", "b": "TRASHED"}


def test_policy(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, 0.0), (-800.0, 800.0), (inf, 0.0), (nan, 0.0), (None, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(policy.classify(F.col("a"), F.col("b"), 0.5)).collect()] == ["SENSITIVE", "SAFE"] + ["QUARANTINED"] * 3
    assert df.select(policy.classify(F.col("a"), F.col("b"), None)).first()[0] == "QUARANTINED"


def test_metrics(spark):
    q = spark.createDataFrame([(1, "en"), (2, "ru")], "query_id long, language string")
    ranking = spark.createDataFrame([(1, "cat", 1), (1, "dog", 2), (2, "cat", 1), (2, "dog", 2)], "query_id long, id string, rank int")
    relevant = spark.createDataFrame([(1, "cat"), (2, "dog")], "query_id long, id string")
    assert {r.language: (r.recall_1, r.mrr) for r in ev.retrieval_metrics(q, ranking, relevant).collect()} == {"en": (1.0, 1.0), "ru": (0.0, 0.5)}
    pair = spark.createDataFrame([("ru", "Мой кот", "Мой кит")], "language string, expected string, actual string")
    assert ev.character_errors(pair).first().cer == round(1 / 7, 6) and ev.word_errors(pair).first().wer == 0.5
    f = spark.createDataFrame([(True, 0.3), (False, 0.5)], "same boolean, score double")
    assert tuple(ev.face_metrics(f, 0.4).first()) == (1.0, 1.0)
    a, b = (spark.createDataFrame(x, "id long, v string") for x in ([(1, "x"), (2, "y")], [(1, "x")]))
    with pytest.raises(Exception, match="exactly once"):
        ev.aligned(a, b.withColumnRenamed("v", "w"), "id").collect()


def test_ctc(spark):
    best = [1, 1, 0, 2, 0, 2, 3, 4]
    steps = spark.createDataFrame([(0, s, c, 0.996 if c == b else 0.001) for s, b in enumerate(best) for c in range(5)], "id int, step int, class int, probability double")
    symbols = spark.createDataFrame([(1, "а"), (2, "б"), (3, "A"), (4, " ")], "class int, symbol string")
    r = ev.ctc_collapse(steps, symbols).first()
    assert r.text == "аббA " and r.confidence > 0.99


def test_vectors(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((400, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    near = spark.createDataFrame([(i, (v[i] + 0.3 * r.standard_normal(64)).tolist()) for i in range(20)], "query_id long, embedding array<double>")
    exact, approx = vs.search_exact(df, near, 5), vs.search_ann(df, near, 5)
    assert {(x.query_id, x.vec_id) for x in exact.where("rank = 1").collect()} == {(i, i) for i in range(20)}
    assert vs.parity(exact, approx, 1).agg(F.avg("recall")).first()[0] >= 0.9
    bad = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, float("nan")]), (2, [1.0]), (3, None), (4, [3.0, 4.0])], "vec_id long, embedding array<double>")
    ok, rejected = vs.load_vectors(bad, 2)
    assert [x.vec_id for x in ok.collect()] == [4] and rejected.count() == 4
    assert ok.select(nx.l2_normalize(F.col("embedding"))).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="no direction"):
        bad.select(nx.l2_normalize(F.col("embedding"))).collect()


def test_token_report(spark):
    docs = spark.createDataFrame([(1, "en", "playing, 漢play zq"), (2, "en", None)], "doc_id long, lang string, text string")
    vocab = spark.createDataFrame([(p,) for p in ("play", "ing", "i", ",", "漢")], "piece string")
    tokens, rates = tokenize_corpus(docs, vocab, max_len=5)
    assert [tuple(r) for r in tokens.collect()] == [(1, "en", 6, True)]
    assert [tuple(r) for r in rates.collect()] == [("en", 5, 0.2)]


def test_search_limits_and_organise_twice(spark):
    with pytest.raises(ValueError):
        search.catalog_search({}, search.CatalogSearch(limit=121))
    v = spark.createDataFrame([("a",), ("b",)], "media_id string")
    tags = spark.createDataFrame([("a", "x")], "media_id string, tag_key string")
    once = search.organise(v, v, tags, "tag_key", "x")
    assert once.count() == search.organise(v, v, once, "tag_key", "x").count() == 2
    assert search.organise(v, v, once, "tag_key", "x", remove=True).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_edit_distance_equals_the_full_table():
    import random

    import numpy as np

    def slow(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, old = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        return row[-1]

    r = random.Random(5)
    for n in [0, 1, 2, 5, 20, 90] * 25:
        x = [r.randrange(r.choice([2, 5, 50])) for _ in range(n)]
        y = [c for c in x if r.random() > 0.1]
        for _ in range(r.randint(0, n // 3 + 2)):
            y.insert(r.randint(0, len(y)), r.randrange(6))
        if r.random() < 0.2:
            y = [r.randrange(5) for _ in range(r.randint(0, 150))]
        assert ev.edit_distance(np.array(x, int), np.array(y, int)) == slow(x, y), (x, y)
    long = np.arange(200_000) % 97
    assert ev.edit_distance(long, np.concatenate([[5], long[:-1]])) <= 2 and ev.edit_distance(long, np.where(np.arange(200_000) % 1000 == 0, 500, long)) == 200


def test_near_pairs_of_many_copies_and_tiles(spark):
    from pyspark.sql import functions as F

    copies = spark.range(50_000).select("id", F.lit(3).cast("long").alias("bits")).union(spark.createDataFrame([(90_000, 1), (90_001, (1 << 40) - 1), (90_002, None)], "id long, bits long"))
    assert [tuple(r) for r in dedup.near_pairs(copies).collect()] == [(1, 3, 1)]
    some = spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("bits"))
    whole = sorted(map(tuple, dedup.near_pairs(some, 6).collect()))
    assert whole == sorted(map(tuple, dedup.near_pairs(some, 6, tile=40).collect())) and len(whole) > 100


def test_fingerprint_decoder_and_failures(spark):
    from pyspark.sql import functions as F

    live = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 1, 1)], "media_id string, content_revision long, access_epoch long")
    content = spark.createDataFrame([("a", "xy"), ("b", ""), ("c", "z")], "media_id string, content string")
    decoder = lambda c: F.when(c != "", F.length(c).cast("long"))
    good, bad = dedup.fingerprint(live, content, decoder)
    assert {(r.media_id, r.bits) for r in good.collect()} == {("a", 2), ("c", 1)} and {r.media_id for r in bad.collect()} == {"b", "d"}
    good, again = dedup.fingerprint(live, content, decoder, bad)
    assert good.count() == 2 and again.count() == 0
