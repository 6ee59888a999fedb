"""Faces to people: clustering in bounded windows, then manual corrections."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mediaframe.plans.graph import connected_components
from mediaframe.plans.lineage import cut_lineage

SIDES = ("off", "rest")


def canonical(merges: DataFrame) -> DataFrame:
    """(person_id, root): the end of each merge chain, by pointer doubling; a cycle is an error.

    A person merged into several follows the smallest. Each round doubles the steps already
    taken, so a chain of n people takes about log2 n joins.
    """
    pointers = merges.where("from_person_id <> into_person_id").groupBy(F.col("from_person_id").alias("person_id")).agg(F.min("into_person_id").alias("root"))
    pointers = cut_lineage(pointers)
    for _ in range(pointers.count().bit_length() + 2):  # a chain of n ends within log2 n doublings, a cycle never
        nxt = pointers.select(F.col("person_id").alias("root"), F.col("root").alias("beyond"))
        moved = cut_lineage(pointers.join(nxt, "root", "left").select("person_id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if moved.where("person_id = root").limit(1).count():
            raise ValueError("merges close a cycle")
        if not moved.where("moved").limit(1).count():
            return moved.drop("moved")
        pointers = moved.drop("moved")
    raise ValueError("merges close a cycle")


def merged_sources(merges: DataFrame, person_id: str) -> DataFrame:
    """All persons merged, over any number of steps, into the one that this person stands for by now."""
    roots = canonical(merges)
    target = roots.where(F.col("person_id") == person_id).agg(F.coalesce(F.first("root"), F.lit(person_id)).alias("target"))  # one row
    return roots.join(F.broadcast(target), F.col("root") == F.col("target")).select("person_id")


def replay_merges(log: DataFrame) -> DataFrame:
    """The log (seq, action MERGE or UNMERGE, from_person_id, into_person_id) with an outcome for each edit.

    Edits count in the order of `seq`. A merge into oneself, or one that would close a cycle as things stand
    then, is 'rejected' and changes nothing; a later merge or unmerge of the same person makes an
    earlier one 'superseded'; an unmerge is 'applied', or 'idle' if there was nothing to undo; the merges
    left are 'in force' and can be given to `canonical`. Persons that no edit ties together do not
    meet: each connected component of the log is replayed by itself, so a component's edits, which
    people make by hand, must fit into one task.
    """
    edits = cut_lineage(log.select("seq", "action", "from_person_id", "into_person_id"))
    part = connected_components(edits, "from_person_id", "into_person_id").select(F.col("node").alias("from_person_id"), "component")
    grouped = edits.join(part, "from_person_id", "left").withColumn("component", F.coalesce("component", "from_person_id"))

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        into, by, outcome = {}, {}, []
        for i, (action, a, b) in enumerate(zip(rows["action"], rows["from_person_id"], rows["into_person_id"])):
            if action == "MERGE":
                end = b
                while end != a and end in into:
                    end = into[end]
                if end == a:
                    outcome.append("rejected")
                    continue
            outcome.append("in force" if action == "MERGE" else "applied" if a in into else "idle")
            if a in by:
                outcome[by.pop(a)] = "superseded"
                del into[a]
            if action == "MERGE":
                into[a], by[a] = b, i
        return rows.assign(outcome=outcome)[["seq", "action", "from_person_id", "into_person_id", "outcome"]]

    schema = edits.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",outcome:string"
    return grouped.groupBy("component").applyInPandas(replay, schema.replace(":", " "))


def visible_faces(faces: DataFrame, live: DataFrame, decisions: DataFrame) -> DataFrame:
    """Faces of live media with their manual decision, if any."""
    return faces.join(live.select("media_id"), "media_id", "left_semi").join(decisions, "anchor_id", "left")


def resolve_people(faces: DataFrame, decisions: DataFrame, merges: DataFrame) -> DataFrame:
    """(detection_id, anchor_id, person_id, excluded).

    A face's own assignment counts first, else the smallest canonical assignment in its cluster,
    else the cluster itself; what results is followed through the merges.
    """
    roots = canonical(merges)
    known = decisions.join(roots.withColumnRenamed("root", "canon"), "person_id", "left").select("anchor_id", "decision", F.coalesce("canon", "person_id").alias("assigned"))
    f = faces.select("detection_id", "anchor_id", "computed_cluster_id").join(known, "anchor_id", "left")
    cluster = f.where("decision = 'ASSIGN'").groupBy("computed_cluster_id").agg(F.min("assigned").alias("inherited"))
    person = F.coalesce(F.when(F.col("decision") == "ASSIGN", F.col("assigned")), "inherited", "computed_cluster_id")
    return f.join(cluster, "computed_cluster_id", "left").select("detection_id", "anchor_id", person.alias("person_id"), F.coalesce(F.col("decision") == "EXCLUDE", F.lit(False)).alias("excluded"))


def person_groups(resolved: DataFrame, people: DataFrame) -> DataFrame:
    """Faces of each person without the excluded, with names where known."""
    return resolved.where("not excluded").groupBy("person_id").agg(F.count("*").alias("faces")).join(people, "person_id", "left")


def excluded_faces(resolved: DataFrame) -> DataFrame:
    return resolved.where("excluded").select("detection_id", "anchor_id")


def cluster_faces(faces: DataFrame, sides: DataFrame, threshold: float = 0.363, window: int = 128) -> DataFrame:
    """(detection_id, anchor_id, cluster_id): greedy complete-link clusters inside windows of faces.

    `faces` has chunk (a window of at most `window` faces), detection_id, anchor_id, embedding; `sides`
    (anchor_id, side, owner) says what must stay apart. In a window, by anchor, a face joins the first
    cluster all of whose members are at the threshold or above and on no other side of an owner; else
    it begins 'auto:' + its anchor.
    """
    where = faces.select(F.col("chunk").alias("in_chunk"), F.col("anchor_id").alias("of")).distinct()
    known = sides.join(where, sides["anchor_id"] == where["of"]).select(F.col("in_chunk").alias("chunk"), F.col("of").alias("anchor_id"), "side", "owner")

    def greedy(f: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["anchor_id", "detection_id"])
        v = np.stack(f["embedding"].map(lambda x: np.asarray(x, float)))
        n = np.linalg.norm(v, axis=1)
        unit = v / np.where(n > 0, n, 1)[:, None]
        near = (np.where((n[:, None] > 0) & (n[None, :] > 0), unit @ unit.T, -1.0) >= threshold)
        anchors, place = f["anchor_id"].tolist(), {}
        for i, a in enumerate(anchors):
            place.setdefault(a, []).append(i)
        for _, own in held.groupby("owner"):
            left, right = ([i for a in own.loc[own["side"] == s, "anchor_id"] for i in place[a]] for s in SIDES)
            near[np.ix_(left, right)] = near[np.ix_(right, left)] = False
        clusters, out = [], []
        for i in range(len(anchors)):
            for c in clusters:
                if near[i, c].all():
                    c.append(i)
                    break
            else:
                clusters.append(c := [i])
            out.append("auto:" + anchors[c[0]])
        return pd.DataFrame({"detection_id": f["detection_id"].to_numpy(), "anchor_id": anchors, "cluster_id": out})

    return faces.select("chunk", "detection_id", "anchor_id", "embedding").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(
        lambda f, l: greedy(f, l) if len(f) else pd.DataFrame({"detection_id": [], "anchor_id": [], "cluster_id": []}, dtype=object), "detection_id string, anchor_id string, cluster_id string")


def apply_edits(log: DataFrame, key: tuple[str, ...] = ("anchor_id",)) -> DataFrame:
    """The decision in force for each anchor, or other `key` that edits are made for: the latest edit, unless it clears."""
    last = log.groupBy(*key).agg(F.max(F.struct("updated_at", "action", "person_id")).alias("e"))
    return last.select(*key, F.col("e.action").alias("decision"), "e.person_id").where("decision <> 'CLEAR'")


@dataclass
class PeopleState:
    """Decisions (anchor_id, decision, person_id), sides (anchor_id, side, owner) and splits (person_id, from_person_id).

    Two anchors must stay apart where an owner has them on different sides. So a split costs one row a
    face, not one a pair.
    """
    decisions: DataFrame
    sides: DataFrame
    splits: DataFrame


def split_person(state: PeopleState, resolved: DataFrame, anchors: DataFrame, person_id: str, new_person_id: str) -> PeopleState:
    """The anchors become the new person's, and stay apart from the other faces of the old one that are not excluded."""
    moved = anchors.select("anchor_id").distinct()
    rest = resolved.where((F.col("person_id") == person_id) & ~F.col("excluded")).select("anchor_id").distinct().join(moved, "anchor_id", "left_anti")
    owner = F.lit(f"split:{new_person_id}").alias("owner")
    sides = moved.select("anchor_id", F.lit(SIDES[0]).alias("side"), owner).union(rest.select("anchor_id", F.lit(SIDES[1]), owner))
    assigned = moved.select("anchor_id", F.lit("ASSIGN").alias("decision"), F.lit(new_person_id).alias("person_id"))
    one = state.decisions.sparkSession.range(1).select(F.lit(new_person_id).alias("person_id"), F.lit(person_id).alias("from_person_id"))
    return PeopleState(state.decisions.select("anchor_id", "decision", "person_id").join(moved, "anchor_id", "left_anti").unionByName(assigned), state.sides.unionByName(sides), state.splits.unionByName(one))


def undo_split(state: PeopleState, new_person_id: str) -> PeopleState:
    """The anchors assigned to the split person go back to the one it came from, and its owner's sides go; without such a split nothing changes.

    What another owner keeps apart stays apart.
    """
    undone = F.broadcast(state.splits.where(F.col("person_id") == new_person_id).select("person_id", F.col("from_person_id").alias("_back")).distinct())  # one row at most
    given = (F.col("decision") == "ASSIGN") & F.col("_back").isNotNull()
    decisions = state.decisions.join(undone, "person_id", "left").select("anchor_id", "decision", F.when(given, F.col("_back")).otherwise(F.col("person_id")).alias("person_id"))
    owner = undone.select(F.concat(F.lit("split:"), "person_id").alias("owner"))
    return PeopleState(decisions, state.sides.join(owner, "owner", "left_anti").select("anchor_id", "side", "owner"), state.splits.where(F.col("person_id") != new_person_id))


def keep_apart(pairs: DataFrame) -> DataFrame:
    """Sides of pairs (a, b) that a user sets apart by hand, each pair under an owner of its own."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().withColumn("owner", F.concat(F.lit("manual:"), "a", F.lit("|"), "b"))
    return ordered.select(F.col("a").alias("anchor_id"), F.lit(SIDES[0]).alias("side"), "owner").union(ordered.select("b", F.lit(SIDES[1]), "owner"))


def apart(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Of the pairs (a, b), in either order, those that an owner has on different sides; each once, smaller id first."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: sides.select(F.col("anchor_id").alias(n), F.col("side").alias(f"side_{n}"), "owner")
    return ordered.join(side("a"), "a").join(side("b"), ["b", "owner"]).where("side_a <> side_b").select("a", "b").distinct()


def rewrite_ids(table: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """`column` with old ids replaced by those of `mapping` (old_id, new_id)."""
    joined = table.join(mapping.select(F.col("old_id").alias(column), "new_id"), column, "left")
    return joined.withColumn(column, F.coalesce("new_id", column)).drop("new_id").select(*table.columns)


def rewrite_merges(merges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Merges with rewritten ids; those into themselves go, of doubles the newest stays."""
    m = rewrite_ids(rewrite_ids(merges, mapping, "from_person_id"), mapping, "into_person_id").where("from_person_id <> into_person_id")
    w = Window.partitionBy("from_person_id").orderBy(F.col("updated_at").desc(), "into_person_id")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def name_uuid(column: str) -> Column:
    """Deterministic version-3 style id of a name."""
    h = F.md5(F.col(column))
    variant = F.substring(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))), 1, 2)
    return F.lower(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12)))
