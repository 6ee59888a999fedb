"""Merges, splits, typed searches and returning imports, as known cases."""
import random
import uuid

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import generation as gen, people, search

FACES = "detection_id string, anchor_id string, computed_cluster_id string"


def state(spark, decisions=()):
    return people.PeopleState(spark.createDataFrame(list(decisions), "anchor_id string, decision string, person_id string"),
                              spark.createDataFrame([], "anchor_id string, side string, owner string"), spark.createDataFrame([], "person_id string, from_person_id string"))


def test_sources_of_a_person_merged_away(spark):
    merges = spark.createDataFrame([("p2", "p1"), ("p1", "p0"), ("x", "y")], "from_person_id string, into_person_id string")
    for person in ("p0", "p1", "p2"):
        assert {r.person_id for r in people.merged_sources(merges, person).collect()} == {"p1", "p2"}
    assert people.merged_sources(merges, "nobody").count() == 0


def test_edits_that_would_close_a_cycle_are_rejected(spark):
    log = [(1, "MERGE", "a", "b"), (2, "MERGE", "b", "c"), (3, "MERGE", "c", "a"), (4, "MERGE", "d", "d"), (5, "UNMERGE", "b", None), (6, "MERGE", "c", "a"),
           (7, "MERGE", "a", "e"), (8, "UNMERGE", "z", None), (9, "MERGE", "b", "c")]
    got = people.replay_merges(spark.createDataFrame(log, "seq long, action string, from_person_id string, into_person_id string"))
    assert {r.seq: r.outcome for r in got.collect()} == {1: "superseded", 2: "superseded", 3: "rejected", 4: "rejected", 5: "applied", 6: "in force", 7: "in force", 8: "idle", 9: "in force"}
    assert {r.person_id: r.root for r in people.canonical(got.where("outcome = 'in force'")).collect()} == {"a": "e", "b": "e", "c": "e"}


def test_replayed_merges_never_cycle(spark):
    r = random.Random(4)
    log = [(i, r.choice(["MERGE"] * 4 + ["UNMERGE"]), f"p{r.randrange(9)}", f"p{r.randrange(9)}") for i in range(300)]
    people.canonical(people.replay_merges(spark.createDataFrame(log, "seq long, action string, from_person_id string, into_person_id string")).where("outcome = 'in force'")).collect()


def test_two_splits_of_one_person_one_undone(spark):
    faces = spark.createDataFrame([(f"d{i}", f"a{i}", "k") for i in range(6)], FACES)
    none = spark.createDataFrame([], "from_person_id string, into_person_id string")
    now = lambda s: people.resolve_people(faces, s.decisions, none)
    anchors = lambda *x: spark.createDataFrame([(a,) for a in x], "anchor_id string")
    first = state(spark, [(f"a{i}", "ASSIGN", "p") for i in range(6)])
    one = people.split_person(first, now(first), anchors("a0", "a1"), "p", "q")
    two = people.split_person(one, now(one), anchors("a2"), "p", "r")
    assert two.sides.count() == 6 + 4  # a row a face, not one a pair
    assert {x.anchor_id: x.person_id for x in now(two).collect()} == {"a0": "q", "a1": "q", "a2": "r", "a3": "p", "a4": "p", "a5": "p"}
    undone = people.undo_split(two, "q")
    assert {x.anchor_id: x.person_id for x in now(undone).collect()} == {"a0": "p", "a1": "p", "a2": "r", "a3": "p", "a4": "p", "a5": "p"}
    pairs = spark.createDataFrame([(f"a{i}", f"a{j}") for i in range(6) for j in range(i)], "a string, b string")
    assert {(x.a, x.b) for x in people.apart(pairs, undone.sides).collect()} == {("a2", f"a{i}") for i in (3, 4, 5)}
    assert {x.person_id for x in undone.splits.collect()} == {"r"}
    same = people.undo_split(undone, "nobody")
    assert same.decisions.count() == 6 and same.sides.count() == undone.sides.count()


def test_a_pair_with_another_owner_stays_apart(spark):
    faces = spark.createDataFrame([("d1", "a", "k"), ("d2", "b", "k")], FACES)
    first = state(spark, [("a", "ASSIGN", "p"), ("b", "ASSIGN", "p")])
    manual = people.PeopleState(first.decisions, people.keep_apart(spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c")], "a string, b string")), first.splits)
    resolved = people.resolve_people(faces, first.decisions, spark.createDataFrame([], "from_person_id string, into_person_id string"))
    split = people.split_person(manual, resolved, spark.createDataFrame([("a",)], "anchor_id string"), "p", "q")
    pair = spark.createDataFrame([("b", "a")], "a string, b string")
    assert people.apart(pair, split.sides).count() == 1 == people.apart(pair, people.undo_split(split, "q").sides).count()
    assert people.apart(pair, first.sides).count() == 0


def test_names_as_ids(spark):
    names = ["auto:1", "", "Éclair", "person:42"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", people.name_uuid("n").alias("u")).collect()
    class Bare:
        bytes = b""
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid3(Bare, n)) for n in names}


@pytest.fixture
def catalogue(spark):
    row = lambda i, name, at: (i, 1, 1, "AVAILABLE", "DEVICE", name, at, None, None)
    media = spark.createDataFrame([row("m1", "IMG_СНИМОК.jpg", "2024-01-03"), row("m2", "Café 50%.png", "2024-01-02"), row("m3", "other", "2024-01-01")],
        "media_id string, content_revision long, access_epoch long, availability string, source string, display_name string, t string, added_at timestamp_ntz, trashed_at timestamp_ntz").withColumn("taken_at", F.col("t").cast("timestamp_ntz")).drop("t")
    return {"media": media, "exposure": spark.createDataFrame([("m1", 1, "SAFE"), ("m2", 1, "SAFE"), ("m3", 1, "SENSITIVE")], "media_id string, content_revision long, exposure string"),
            "media_tag": spark.createDataFrame([("m1", "cat"), ("m3", "cat")], "media_id string, tag_key string"),
            "ai_ocr_result": spark.createDataFrame([("g1", f"m{i}", 1, 1, "Hello \t World\n\n  again ") for i in (1, 2, 3)], "generation_id string, media_id string, content_revision long, access_epoch long, display_text string")}


@pytest.mark.parametrize("conditions,found", [
    ({"name": "IMG"}, ["m1"]), ({"name": "img_снимок"}, ["m1"]), ({"name": "СНИМОК"}, ["m1"]), ({"name": "CAFÉ"}, ["m2"]), ({"name": "0%."}, ["m2"]), ({"name": "_5"}, []),
    ({"tag": " Cat "}, ["m1"]), ({"tag": "  "}, ["m1", "m2"]), ({"ocr": "Hello   WORLD again", "ocr_generation": "g1"}, ["m1", "m2"]), ({"ocr": "Hello", "ocr_generation": "g2"}, []),
    ({"ocr": "hello\nworld", "ocr_generation": "g1", "include_protected": True}, ["m1", "m2", "m3"]), ({"include_protected": True, "offset": 1, "limit": 1}, ["m2"]), ({"ocr": " \n"}, ["m1", "m2"]),
])
def test_what_is_typed_is_normalised(catalogue, conditions, found):
    assert [r.media_id for r in search.catalog_search(catalogue, search.CatalogSearch(**conditions)).collect()] == found


def test_searches_that_are_refused(catalogue):
    for conditions in ({"ocr": "hello"}, {"limit": 0}, {"limit": 121}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.catalog_search(catalogue, search.CatalogSearch(**conditions))


def test_an_import_that_comes_back_gets_a_new_epoch(spark):
    columns = "media_id string, source string, availability string, content_revision long, access_epoch long, size long, taken_at timestamp_ntz, added_at timestamp_ntz, date_source string"
    import datetime

    day = datetime.datetime(2020, 1, 1)
    media = spark.createDataFrame([("back", "GOOGLE_IMPORT", "MISSING", 1, 7, 10, None, day, "FILE_MODIFIED"), ("same", "GOOGLE_IMPORT", "AVAILABLE", 1, 7, 10, day, None, "EXIF"),
        ("changed", "GOOGLE_IMPORT", "AVAILABLE", 1, 7, 10, day, None, "EXIF"), ("gone", "GOOGLE_IMPORT", "INACCESSIBLE", 1, 7, 10, day, None, "TAKEN"),
        ("trashed", "GOOGLE_IMPORT", "TRASHED", 1, 7, 10, day, None, "EXIF"), ("device", "DEVICE", "MISSING", 1, 7, 10, day, None, "EXIF")], columns)
    there = datetime.datetime(2021, 2, 3)
    files = spark.createDataFrame([("back", 1, 10, day), ("same", 1, 10, day), ("changed", 1, 11, day), ("trashed", 2, 10, day), ("new", 5, 3, there), ("undated", 0, 4, None)], "media_id string, file_revision long, file_size long, modified_at timestamp_ntz")
    got = {r.media_id: r for r in gen.reconcile_imports(media, files).collect()}
    told = {k: (r.availability, r.access_epoch, r.content_revision, r.date_source, r.day_key) for k, r in got.items()}
    assert told == {"back": ("AVAILABLE", 8, 1, "FILE_MODIFIED", "2020-01-01"), "same": ("AVAILABLE", 7, 1, "EXIF", "2020-01-01"), "changed": ("AVAILABLE", 7, 1, "FILE_MODIFIED", "undated"),
                    "gone": ("MISSING", 7, 1, "TAKEN", "2020-01-01"), "trashed": ("TRASHED", 7, 1, "EXIF", "2020-01-01"), "device": ("MISSING", 7, 1, "EXIF", "2020-01-01"),
                    "new": ("AVAILABLE", 1, 5, "FILE_MODIFIED", "2021-02-03"), "undated": ("AVAILABLE", 1, 0, "UNKNOWN", "undated")}
    assert got["changed"].size == 11 and got["new"].source == "GOOGLE_IMPORT"
