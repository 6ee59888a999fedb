"""Vector search: exact and approximate top-k, parity and pooling."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mediaframe.functions.numbers import cosine, dot, finite, norm
from mediaframe.operators.fence import coverage
from mediaframe.plans.lineage import shared_folder

MAX_QUERIES, MAX_CELLS, SAMPLE_ROWS, LIST, PARTS = 10_000, 4096, 100_000, 1024, 16
LISTS = "cell long, n long, ids binary, vectors binary"


def load_vectors(df: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the dimension, only finite parts and a length; and the rejected rest."""
    good = F.coalesce((F.size(column) == dim) & finite(F.col(column)) & (norm(F.col(column)) > 0), F.lit(False))
    return df.where(good), df.where(~good)


def _unit(rows) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in rows])
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")


def _best(vectors: DataFrame, q: pd.DataFrame, k: int) -> DataFrame:
    """The k best rows for each query of `q` among all vectors; each Arrow batch keeps its own."""
    if q.empty:
        return _nothing(vectors.sparkSession)
    matrix, ids = _unit(q["embedding"]), q["query_id"].to_numpy()

    def local(batches):
        for b in batches:
            if b.empty:
                continue
            v, vec = _unit(b["embedding"]), b["vec_id"].to_numpy()
            keep = np.isfinite(v).all(axis=1)
            by = np.argsort(vec[keep], kind="stable")
            v, vec = v[keep][by], vec[keep][by]
            step = max(1, (1 << 21) // max(len(vec), 1))  # so many queries that a block of scores is 16 MB
            for lo in range(0, len(ids), step):
                some = matrix[lo : lo + step]
                score = np.round(some @ v.T, 6)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(score, top, axis=1)
                yield (out := pd.DataFrame({"query_id": np.repeat(ids[lo : lo + step], top.shape[1]), "vec_id": vec[top].reshape(-1), "score": score.reshape(-1)}))[np.isfinite(out["score"])]

    best = vectors.select("vec_id", "embedding").mapInPandas(local, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, most: int):
    """The queries in pandas frames of about `most` rows at the most."""
    q = queries.select("query_id", "embedding")
    n = max(1, -(-q.count() // most))
    for i in range(n):
        yield (q if n == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toPandas()


def search_exact(vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of highest cosine for each query, ties by id.

    The queries go to every task in blocks of about `max_queries`; each Arrow batch keeps its own
    top k, so what is shuffled is k rows a query and batch. Scores are rounded to six places before ranks.
    """
    return reduce(DataFrame.union, [_best(vectors, q, k) for q in _blocks(queries, max_queries)])


def semantic_search(vectors: DataFrame, queries: DataFrame, live: DataFrame, derived: DataFrame, k: int, encode: Callable[[DataFrame], DataFrame] | None = None, generation_complete: bool = True, index: VectorIndex | None = None) -> DataFrame:
    """The k best with indexed, available and complete: how much of the live media the derived vectors cover.

    Complete means that the generation is, that every live row has its vector, and that no stored row of
    the generation has gone stale. `encode` turns the queries (query_id and whatever it needs, such as a
    text) into query_id, embedding. With an `index` of `vectors` the search is approximate, else exact.
    """
    stored = derived.agg(F.count("*").alias("stored"))  # one row each
    whole = F.lit(generation_complete) & (F.col("indexed") == F.col("eligible")) & (F.col("stored") == F.col("indexed"))
    seen = coverage(live, {"indexed": derived}).join(F.broadcast(stored), F.lit(True)).select("indexed", F.col("eligible").alias("available"), whole.alias("complete"))
    asked = queries if encode is None else encode(queries)
    found = search_exact(vectors, asked, k) if index is None else search_ann(vectors, asked, k, index)
    return found.join(F.broadcast(seen), F.lit(True))


@dataclass
class VectorIndex:
    """Posting lists in a folder, by cell; the cells' centres; and how many cells a query looks at.

    A list is a row of at most `LIST` vectors of one cell; neighbouring cells share one of `PARTS` folders. `sizes` counts each cell's vectors. The folder is shared by all executors and outlives the search, so
    that one index serves many.
    """
    path: str
    kind: str  # of the stored numbers
    centres: np.ndarray
    sizes: np.ndarray
    probes: int

    def cells(self, unit: np.ndarray, probes: int | None = None) -> np.ndarray:
        """(queries, probes): the nearest cells of each unit vector, nearest first."""
        near = unit @ self.centres.T
        n = min(probes or self.probes, len(self.centres))
        some = np.argpartition(-near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)

    def scored(self, unit: np.ndarray) -> int:
        """How many pairs of query and vector a search of these queries scores."""
        return int(self.sizes[self.cells(unit)].sum())


def _centres(sample: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; a centre that loses all its rows moves to the row that fits worst."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        cell, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = np.flatnonzero(length[:, 0] == 0)
        centres = np.divide(sums, length, out=centres.copy(), where=length > 0)
        centres[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
    return centres


def build_index(vectors: DataFrame, k: int = 10, recall: float = 0.95, max_cells: int = MAX_CELLS, sample_rows: int = SAMPLE_ROWS, trial_queries: int = 64, rounds: int = 10, seed: int = 7) -> VectorIndex:
    """Trains cells on at most `sample_rows` vectors, those of the smallest hashes in the whole table, and puts every vector into its nearest cell.

    There are about as many cells as the square root of the vectors, `max_cells` at most. `probes` is the
    least number of nearest cells with which `trial_queries` of the sample find `recall` of their true k
    neighbours, which exact search over all vectors tells: vectors in clusters need few, vectors
    without clusters most. Vectors without a direction are left out, as from exact search. Cells are
    written by ranges of cell and id, so that a crowded one is split over tasks and files.
    """
    chosen = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    unit = _unit(chosen["embedding"]) if len(chosen) else np.zeros((0, 1))
    good = np.isfinite(unit).all(axis=1)
    sample = unit[good]
    path = f"{shared_folder(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}"
    total = vectors.count()
    n = int(np.clip(round(total ** 0.5), 1, min(max_cells, max(len(sample), 1))))
    centres = _centres(sample, n, rounds, seed) if len(sample) else np.zeros((1, unit.shape[1]))

    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def place(batches):
        for b in batches:
            if not b.empty:
                v = _unit(b["embedding"])
                keep = np.isfinite(v).all(axis=1)
                yield pd.DataFrame({"cell": (v[keep] @ centres.T).argmax(axis=1), "vec_id": b["vec_id"][keep].to_numpy(), "vector": [np.asarray(x, kind).tobytes() for x in b["embedding"][keep]]})

    def pack(batches):
        for b in batches:
            for cell, some in b.groupby("cell"):
                for lo in range(0, len(some), LIST):
                    part = some.iloc[lo : lo + LIST]
                    yield pd.DataFrame({"cell": [cell], "n": [len(part)], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "vectors": [b"".join(part["vector"])], "part": [cell * PARTS // len(centres)]})

    placed = vectors.select("vec_id", "embedding").mapInPandas(place, "cell long, vec_id long, vector binary")
    lists = placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").mapInPandas(pack, f"{LISTS}, part int")
    lists.write.partitionBy("part").parquet(path)
    index = VectorIndex(path, kind, centres, np.zeros(len(centres), np.int64), len(centres))
    for r in _postings(vectors.sparkSession, index).groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
        index.sizes[r.cell] = r.n
    tried = chosen[good].head(trial_queries).rename(columns={"vec_id": "query_id"})
    near = _best(vectors, tried, k).select("query_id", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").toPandas() if len(tried) else pd.DataFrame()
    if len(near):
        of = pd.Series(np.arange(len(tried)), tried["query_id"].to_numpy())
        order, cell = index.cells(_unit(tried["embedding"])), (_unit(near["embedding"]) @ centres.T).argmax(axis=1)
        at = (order[of[near["query_id"]].to_numpy()] == cell[:, None]).argmax(axis=1)  # the probe that meets each neighbour
        index.probes = int(np.sort(at)[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1
    return index


def _postings(spark: SparkSession, index: VectorIndex) -> DataFrame:
    return spark.read.schema(f"{LISTS}, part int").parquet(index.path)


def search_ann(vectors: DataFrame, queries: DataFrame, k: int, index: VectorIndex | None = None, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of the vectors in each query's nearest cells, with exact scores; `search_exact` is the exact way.

    `index` is what `build_index` made of `vectors`; without one it is built. Only the cells that some query
    looks at are read, and a query meets only the vectors of its own cells, batch by batch, where
    they lie; k rows a query and partition are shuffled. Queries go to every task in blocks.
    """
    index = build_index(vectors, k) if index is None else index
    if not index.sizes.any():
        return _nothing(vectors.sparkSession)
    postings = _postings(vectors.sparkSession, index)
    return reduce(DataFrame.union, [_best_in_cells(postings, q, k, index) for q in _blocks(queries, max_queries)])


def _best_in_cells(postings: DataFrame, q: pd.DataFrame, k: int, index: VectorIndex) -> DataFrame:
    matrix = _unit(q["embedding"]) if len(q) else np.zeros((0, index.centres.shape[1]))
    keep = np.isfinite(matrix).all(axis=1)
    matrix, ids = matrix[keep], q["query_id"].to_numpy()[keep]
    if not len(ids):
        return _nothing(postings.sparkSession)
    cells = index.cells(matrix)
    asking = {c: np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells).tolist()}

    def local(batches):
        held = None
        for b in batches:
            for cell, vec, v in zip(b["cell"], b["ids"], b["vectors"]):
                who, vec = asking[cell], np.frombuffer(vec, "<i8")
                v = np.frombuffer(v, index.kind).reshape(len(vec), -1).astype(float)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                step = max(1, (1 << 21) // len(vec))
                for lo in range(0, len(who), step):
                    part = who[lo : lo + step]
                    score = np.round(matrix[part] @ v.T, 6)
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    found = pd.DataFrame({"query_id": np.repeat(ids[part], top.shape[1]), "vec_id": vec[top].reshape(-1), "score": np.take_along_axis(score, top, 1).reshape(-1)})
                    held = found if held is None else pd.concat([held, found])
                if held is not None and len(held) > 8 * k * len(ids):
                    held = best(held)
        if held is not None:
            yield best(held)

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found[found.groupby("query_id").cumcount() < k]

    parts = sorted({c * PARTS // len(index.centres) for c in asking})
    met = postings.where(F.col("part").isin(parts) & F.col("cell").isin(list(asking))).mapInPandas(local, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parity(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """(query_id, same, recall): whether the ids agree in order, and the share of the exact ones found."""
    ids = lambda df, n: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias(n))
    both = ids(exact, "e").join(ids(approx, "a"), "query_id", "left").withColumn("a", F.coalesce("a", F.array().cast("array<bigint>")))
    return both.select("query_id", (F.col("e") == F.col("a")).alias("same"), F.round(F.size(F.array_intersect("e", "a")) / F.size("e"), 6).alias("recall"))


def probes(vectors: DataFrame, n: int = 8) -> DataFrame:
    return vectors.orderBy("vec_id").limit(n).select(F.col("vec_id").alias("query_id"), "embedding")


def embedding_parity(a: DataFrame, b: DataFrame, atol: float = 1e-4, rtol: float = 1e-3) -> DataFrame:
    """(vec_id, cosine, max_error, close, norm_ratio) of the vectors two tables share."""
    j = a.select("vec_id", F.col("embedding").alias("x")).join(b.select("vec_id", F.col("embedding").alias("y")), "vec_id")
    error = F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    ok = F.forall(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double"))), lambda t: t)
    return j.select("vec_id", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.round(F.array_max(error), 6).alias("max_error"), ok.alias("close"), F.round(norm(F.col("x")) / norm(F.col("y")), 6).alias("norm_ratio"))


def mean_pool(tokens: DataFrame, key: str = "id") -> DataFrame:
    """(key, pooled): mean over the rows whose mask is set, then unit length; `tokens` has key, mask, vector."""
    parts = tokens.where("mask").select(key, F.posexplode("vector").alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("v"))
    return mean.select(key, F.transform("v", lambda x: x / norm(F.col("v"))).alias("pooled"))
