"""Evaluation of retrieval, recognised text, faces and sensitive-media decisions."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from mediaframe.functions.text import nfc

STAGES = ("retrieval", "ocr", "faces", "sensitive")


def read_eval_dataset(spark: SparkSession, path: str, schema: str | None = None) -> dict[str, DataFrame]:
    """Tables photos, queries, ocr, facePairs, sensitive of a JSON dataset, those that it has.

    Where many files are read, `schema` should name the types: to infer them, Spark reads small files whole in a few tasks.
    """
    whole = (spark.read if schema is None else spark.read.schema(schema)).json(path, multiLine=True)
    return {c: whole.select(F.explode(c).alias("x")).select("x.*") for c in ("photos", "queries", "ocr", "facePairs", "sensitive") if c in whole.columns}


def eval_report(spark: SparkSession, metrics: dict[str, DataFrame]) -> DataFrame:
    """(stage, status, metrics as JSON); a stage that did not run says so, and is never zero."""
    rows = [df.select(F.lit(k).alias("stage"), F.to_json(F.struct("*")).alias("m")) for k, df in metrics.items()]
    stages = spark.createDataFrame([(s,) for s in STAGES], "stage string")
    if not rows:
        return stages.select("stage", F.lit("not-run").alias("status"), F.lit(None).cast("string").alias("metrics"))
    union = rows[0]
    for r in rows[1:]:
        union = union.union(r)
    each = union.groupBy("stage").agg(F.array_join(F.array_sort(F.collect_list("m")), "\n").alias("metrics"))
    return stages.join(each, "stage", "left").select("stage", F.when(F.col("metrics").isNull(), "not-run").otherwise("ok").alias("status"), "metrics")


def aligned(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """expected joined to actual one to one; a missing, unknown or repeated key is an error."""
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    bad = n(expected, "e").join(n(actual, "a"), key, "full_outer").where("coalesce(e, 0) <> 1 or coalesce(a, 0) <> 1")
    guard = bad.agg(F.count("*").alias("_bad")).select(F.when(F.col("_bad") > 0, F.raise_error(F.lit("fixtures are not covered exactly once")).cast("int")).otherwise(1).alias("_ok"))
    return expected.join(actual, key).withColumn("_ok", F.lit(1)).join(F.broadcast(guard), "_ok").drop("_ok")


def bad_inputs(scores: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """One row: repeated keys, unknown keys, values that are not finite or outside 0 to 1."""
    repeated = scores.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated")).withColumn("_k", F.lit(1))
    unknown = scores.join(known.select(key), key, "left_anti").agg(F.count("*").alias("unknown")).withColumn("_k", F.lit(1))
    v = F.col(value)
    wrong = scores.agg(F.count_if(v.isNull() | F.isnan(v) | (v < 0) | (v > 1)).alias("out_of_range")).withColumn("_k", F.lit(1))
    return repeated.join(unknown, "_k").join(wrong, "_k").drop("_k")


def validate_run(dataset: DataFrame, run: DataFrame) -> DataFrame:
    """The run's rows, if the digests of dataset and catalogue are those it was made from; else an error."""
    # One row whatever the table holds, so the broadcast is bounded; more or fewer digests than one are an error.
    one = F.when(F.count("*") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("the dataset must have one row of digests")).cast("boolean"))
    d = dataset.agg(F.min("dataset_sha").alias("d"), F.min("catalogue_sha").alias("c"), one.alias("_one")).where("_one").drop("_one")
    same = (F.col("d") == F.col("dataset_sha")) & (F.col("c") == F.col("catalogue_sha"))
    return run.join(F.broadcast(d), F.lit(True)).where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("run belongs to other inputs")).cast("boolean"))).drop("d", "c")


def retrieval_metrics(queries: DataFrame, rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(language, recall@k..., mrr): `rankings` has query_id, id, rank from 1; `relevant` query_id, id."""
    hits = rankings.join(relevant, ["query_id", "id"], "left_semi")
    total = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    found = hits.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.min("rank").alias("first"))
    each = queries.join(total, "query_id", "left").join(found, "query_id", "left")
    recall = [F.round(F.avg(F.coalesce(F.col(f"h{k}") / F.col("relevant"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]
    return each.groupBy("language").agg(*recall, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def edit_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Edit distance of two sequences of numbers.

    What begins and ends alike is left out. As many edits are needed as there are numbers too many
    of on one side, and for equal lengths no more than differ place by place: where these bounds
    meet, that is the distance. Else a column of the table at a time, its cells as bits of whole numbers.
    """
    n = min(len(x), len(y))
    same = np.flatnonzero(x[:n] != y[:n])
    head = int(same[0]) if len(same) else n
    x, y, n = x[head:], y[head:], n - head
    same = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    _, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    surplus = np.bincount(codes[: len(x)], minlength=codes.max() + 1) - np.bincount(codes[len(x) :], minlength=codes.max() + 1)
    least = max(int(surplus[surplus > 0].sum()), int(-surplus[surplus < 0].sum()))
    if len(x) == len(y) and int((x != y).sum()) == least:
        return least
    return _by_bits(codes[: len(x)], codes[len(x) :])


def _by_bits(x: np.ndarray, y: np.ndarray) -> int:
    """Neighbouring cells of the table differ by one at most: two bits a cell of `x` say up or down, and a
    column's step is some dozen operations on numbers of len(x) bits, which carry through all cells at once."""
    if len(x) > len(y):
        x, y = y, x
    places: dict[int, int] = {}
    for at, symbol in enumerate(x.tolist()):
        places[symbol] = places.get(symbol, 0) | 1 << at
    whole, last, distance = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = whole, 0  # of each cell against the one above
    for symbol in y.tolist():
        equal = places.get(symbol, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down  # no step from the cell up and left
        right_up, right_down = down | ~(diagonal | up) & whole, diagonal & up
        distance += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = right_up << 1 | 1, right_down << 1
        up, down = (right_down | ~(diagonal | right_up)) & whole, right_up & diagonal & whole
    return distance


# Rows leave their Arrow batch (10,000 rows or 64 MB) one by one, so no batch stands in Python as objects.
@arrow_udf(LongType())
def token_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two token lists."""
    def one(x, y) -> int:
        codes: dict = {}
        x, y = (np.array([codes.setdefault(t, len(codes)) for t in z], int) for z in (x, y))
        return edit_distance(x, y)

    return pa.array((one(x.as_py(), y.as_py()) for x, y in zip(a, b)), pa.int64())


@arrow_udf(LongType())
def text_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two texts by code points; null if either is."""
    codes = lambda t: np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return pa.array((edit_distance(codes(x), codes(y)) if x.is_valid and y.is_valid else None for x, y in zip(a, b)), pa.int64())


def character_errors(pairs: DataFrame, group: str = "language") -> DataFrame:
    """(group, edits, characters, cer): case counts, texts are compared in NFC, errors are pooled."""
    e, a = nfc(F.col("expected")), nfc(F.col("actual"))
    edits = text_distance("e", "a")
    pairs = pairs.select(group, e.alias("e"), a.alias("a"))
    e = F.col("e")
    return pairs.groupBy(group).agg(F.sum(edits).cast("long").alias("edits"), F.sum(F.length(e)).cast("long").alias("characters")).withColumn("cer", F.round(F.col("edits") / F.nullif(F.col("characters"), F.lit(0)), 6))


def word_errors(pairs: DataFrame, group: str = "language") -> DataFrame:
    """(group, edits, words, wer) over tokens between white space."""
    tokens = lambda c: F.filter(F.split(nfc(F.col(c)), r"\s+"), lambda w: w != "")
    return pairs.select(group, tokens("expected").alias("e"), tokens("actual").alias("a")).groupBy(group).agg(F.sum(token_distance("e", "a")).alias("edits"), F.sum(F.size("e")).cast("long").alias("words")).withColumn("wer", F.round(F.col("edits") / F.nullif(F.col("words"), F.lit(0)), 6))


def face_metrics(pairs: DataFrame, threshold: float) -> DataFrame:
    """One row: false acceptance and false rejection of pairs (same, score) at a threshold."""
    accept = F.col("score") >= threshold
    rate = lambda wrong, of: F.round(F.count_if(wrong & of) / F.nullif(F.count_if(of), F.lit(0)), 6)
    return pairs.agg(rate(accept, ~F.col("same")).alias("far"), rate(~accept, F.col("same")).alias("frr"))


def sensitive_metrics(scores: DataFrame, threshold: float, group: str = "language") -> DataFrame:
    """(group, fpr, fnr) of (sensitive, score) rows; a rate without its class is null."""
    flagged = F.col("score") >= threshold
    rate = lambda wrong, of: F.round(F.count_if(wrong & of) / F.nullif(F.count_if(of), F.lit(0)), 6)
    return scores.groupBy(group).agg(rate(flagged, ~F.col("sensitive")).alias("fpr"), rate(~flagged, F.col("sensitive")).alias("fnr"))


def nms(boxes: DataFrame, min_confidence: float = 0.9, iou: float = 0.3, keep: int = 100) -> DataFrame:
    """Detections of each image that no stronger one overlaps by more than `iou`; at most `keep`."""
    def greedy(b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["confidence"] >= min_confidence].sort_values(["confidence", "box_id"], ascending=[False, True])
        x = b[["left", "top", "right", "bottom"]].to_numpy(float)
        area, alive, out = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]), np.ones(len(b), bool), []
        for i in range(len(b)):
            if alive[i] and len(out) < keep:
                out.append(i)
                w = np.minimum(x[i, 2], x[:, 2]) - np.maximum(x[i, 0], x[:, 0])
                h = np.minimum(x[i, 3], x[:, 3]) - np.maximum(x[i, 1], x[:, 1])
                both = np.clip(w, 0, None) * np.clip(h, 0, None)
                alive &= both <= iou * (area + area[i] - both)
        return b.iloc[out]

    return boxes.groupBy("image_id").applyInPandas(greedy, boxes.schema)


def ctc_collapse(steps: DataFrame, symbols: DataFrame, key: str = "id") -> DataFrame:
    """(key, text, confidence) from (key, step, class, probability): the best class of each step,
    without blanks (class 0) and repeats of the step before; confidence is the mean of what is kept."""
    best = steps.groupBy(key, "step").agg(F.max_by("class", F.struct("probability", -F.col("class"))).alias("class"), F.max("probability").alias("p"))
    before = F.lag("class").over(Window.partitionBy(key).orderBy("step"))
    kept = best.withColumn("before", before).where("class <> 0 and (before is null or before <> class)").join(symbols, "class")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "symbol"))), lambda x: x["symbol"]), "").alias("text"), F.avg("p").alias("confidence"))


def assemble_ocr(regions: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, text, confidence): regions' texts from top to bottom and left to right, and their mean confidence."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda r: r["text"])
    return regions.groupBy(key).agg(F.array_join(parts, "\n").alias("text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
