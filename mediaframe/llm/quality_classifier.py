"""Documents judged by their perplexity under a model of trusted text.

The model is an interpolated modified Kneser-Ney n-gram model of the characters inside words,
one for each language, counted and joined in Spark from all trusted rows but the held-out fifth. Words
do not condition each other, so a block of documents needs each distinct word scored only once.
Two more models of the same kind, of those rows of all languages and of all rows labelled toxic, judge the worst
word: a few words of abuse hardly move a document's perplexity, but are far likelier in the latter.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from mediaframe.llm.arrays import join_hash, mix, split_words, texts_in_blocks
from mediaframe.llm.sqltext import space_words, with_key
from mediaframe.plans.lineage import cut_lineage
from mediaframe.plans.rank import ordered_rank

ORDER, QUANTILE, MARGIN, WORST_MARGIN, MOST_GRAMS, MOST_IDS = 4, 0.99, 1.15, 1.5, 4_000_000, 500_000
BEGIN, END = "\u0002", "\u0003"
_RANGE = 1 << 30
POOL, TOXIC = "\u0004trusted", "\u0004toxic"  # names of the two models of all languages, beside languages' own


def labelled_ids(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(_id, toxic, part): all ids of `docs` that are labelled trusted or toxic, once each.

    Trusted are ids whose labels all say quality 1 and none toxic. Every fifth id of a language by hash, the
    first included, is part 0 and held out; ids of several languages are if they are in one of them.
    """
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("toxic = 1 or q = 1")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE))
    placed = docs.select(F.col(key).alias("doc_id"), "lang").join(judged, "doc_id").select("doc_id", "toxic", F.when(F.col("toxic") == 0, F.col("lang")).otherwise(TOXIC).alias("group"), h.alias("h")).distinct()
    ranked = ordered_rank(placed, [F.col("h"), F.col("doc_id")], "r", [F.col("group")])
    part = F.when(F.col("toxic") == 1, F.lit(1)).otherwise(F.col("r") % 5)
    return cut_lineage(ranked.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"), F.min(part).alias("part")))


def quantiles(df: DataFrame, group: str, value: str, q: float, name: str) -> DataFrame:
    """(group, name): the exact quantile of each group's values that are not null, between neighbours in proportion."""
    ranked = ordered_rank(df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("_v")), [F.col("_v")], "_r", [F.col(group)], "_n")
    at = (F.col("_n") - 1) * F.lit(q)
    share = at - F.floor(at)
    near = ranked.withColumn("_s", F.when(F.col("_r") == F.floor(at), 1 - share).when(F.col("_r") == F.floor(at) + 1, share)).where("_s > 0")
    return near.groupBy(group).agg(F.sum(F.col("_s") * F.col("_v")).alias(name))


def _grams(order: int) -> Column:
    """array<struct<n, gram>>: for every symbol of `s` after the begin mark, the n-grams that end at it."""
    ends = F.sequence(F.lit(2), F.length("s"))
    return F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), F.least(e, F.lit(order))), lambda n: F.struct(
        n.alias("n"), F.substring(F.col("s"), e - n + 1, n).alias("gram")))))


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """From (lang, word, times): (lang, n, gram, raw), how often each n-gram of the words' symbols occurs."""
    s = words.select("lang", F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("s"), "times")
    return s.select("lang", "times", F.explode(_grams(order)).alias("g")).groupBy("lang", F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.sum("times").alias("raw"))


def kneser_ney(words: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """The models of (lang, word, times), as by `smoothed`."""
    return smoothed(gram_counts(words, order), order)


def smoothed(raw: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From (lang, n, gram, raw): (lang, n, gram, logp) and (lang, n, context, logw), natural logarithms.

    Counts below the top order are the numbers of distinct symbols before (raw counts for n-grams
    that begin with the begin mark). Each order's counts meet their context's sums and the lower
    order's probabilities in joins on hashed keys; the lowest is mixed with a uniform one.
    """
    raw = cut_lineage(raw)
    before = raw.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("kinds"))
    counted = raw.join(before, ["lang", "n", "gram"], "left").select("lang", "n", "gram", F.expr(f"substring(gram, 1, n - 1)").alias("context"),
        F.when((F.col("n") == order) | F.col("gram").startswith(BEGIN), F.col("raw")).otherwise(F.coalesce("kinds", "raw")).alias("c"))
    shape = counted.groupBy("lang", "n").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("types"))
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0))
    d = lambda i: F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0)), F.lit(0.5 * i)), F.lit(0.05)), F.lit(i - 0.05))
    shape = shape.select("lang", "n", "types", *[d(i).alias(f"d{i}") for i in (1, 2, 3)])
    c = cut_lineage(counted.join(F.broadcast(shape), ["lang", "n"]).withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))))
    contexts = cut_lineage(c.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("w")))
    probability = None
    for n in range(1, order + 1):
        own = c.where(F.col("n") == n).join(contexts.where(F.col("n") == n).drop("n"), ["lang", "context"])
        if n == 1:
            lower = own.withColumn("q", 1 / (F.col("types") + 1))
        else:
            lower = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(level.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])  # noqa: F821
        level = lower.select("lang", "n", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("w") * F.col("q")).alias("p"))
        probability = level if probability is None else probability.union(level)
    return probability.select("lang", "n", "gram", F.log("p").alias("logp")), contexts.select("lang", "n", "context", F.log("w").alias("logw"))


@dataclass
class CharModels:
    """Tables of all models over shared keys, so that a symbol's n-grams are looked up once for all of them."""
    keys: list[np.ndarray]  # by n: sorted hashes of all n symbols that are an n-gram or a context in any model
    logp: dict[str, list[tuple[np.ndarray, np.ndarray]]]  # by model and n: places in keys, log probabilities
    logw: dict[str, list[tuple[np.ndarray, np.ndarray]]]  # likewise, what backing off from a context of n symbols costs
    unseen: dict[str, float]

    def __contains__(self, name: str) -> bool:
        return name in self.unseen

    def places(self, symbols: np.ndarray) -> list[np.ndarray]:
        """By n: the place in keys of the n symbols that end at each place, or one past the last."""
        out = []
        for keys, ending in zip(self.keys, hashed_ends(symbols, len(self.keys))):
            at = np.searchsorted(keys, ending)
            at[keys[np.minimum(at, len(keys) - 1)] != ending if len(keys) else slice(None)] = len(keys)
            out.append(at)
        return out

    def score(self, name: str, places: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """Log probability of each symbol given up to `depth` symbols before it in its word."""
        out = np.full(len(depth), self.unseen[name])
        for n, at in enumerate(places, 1):
            here = depth >= n - 1
            if n > 1:  # what backing off from this order costs, where the context was seen
                weight = np.zeros(len(self.keys[n - 2]) + 1)
                weight[self.logw[name][n - 2][0]] = self.logw[name][n - 2][1]
                out[1:] += np.where(here[1:], weight[places[n - 2][:-1]], 0.0)
            logp = np.full(len(self.keys[n - 1]) + 1, np.nan)
            logp[self.logp[name][n - 1][0]] = self.logp[name][n - 1][1]
            found = logp[at]
            out = np.where(here & ~np.isnan(found), found, out)
        return out


def hashed_ends(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """By n: hash of the n symbols that end at each place."""
    code = mix(symbols.astype(np.uint64) + np.uint64(1))
    ending = [code]
    for n in range(2, order + 1):
        ending.append(np.concatenate([code[: n - 1], join_hash(ending[-1][n - 2 : -1], code[n - 1 :])]) if len(code) >= n else code)
    return ending


def _chain(texts: list[str]) -> np.ndarray:
    """Hash of each short string's symbols, in the way `score` does."""
    out = np.zeros(len(texts), np.uint64)
    length = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum(length) - length
    for i in range(int(length.max(initial=0))):
        some = length > i
        code = mix(flat[first[some] + i].astype(np.uint64) + np.uint64(1))
        out[some] = code if i == 0 else join_hash(out[some], code)
    return out


def collect_models(grams: DataFrame, contexts: DataFrame, order: int) -> CharModels:
    """The tables as hashes and numbers, for the driver to hold and send: the caller has counted them."""
    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_chain(b.column(2).to_pylist()).view(np.int64)), b.column(3)], names=["lang", "n", "key", "value"])

    def tables(df: DataFrame, text: str, n: Column, value: str) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
        got = df.select("lang", n.cast("int").alias("n"), text, value).mapInArrow(hashed, "lang string, n int, key long, value double").toArrow().combine_chunks()
        names = pc.dictionary_encode(got["lang"]).combine_chunks()
        code, size = names.indices.to_numpy(), got["n"].to_numpy()
        by = np.lexsort((size, code))
        out: dict = {}
        for part in np.split(by, np.flatnonzero(np.diff(code[by]) | np.diff(size[by])) + 1) if len(by) else []:
            out.setdefault(names.dictionary[code[part[0]]].as_py(), {})[int(size[part[0]])] = got["key"].to_numpy()[part].view(np.uint64), got["value"].to_numpy()[part]
        return out

    none = np.empty(0, np.uint64), np.empty(0)
    g, w = tables(grams, "gram", F.col("n"), "logp"), tables(contexts, "context", F.col("n") - 1, "logw")
    keys = [np.unique(np.concatenate([none[0], *[t[name].get(n, none)[0] for t in (g, w) for name in t]])) for n in range(1, order + 1)]
    placed = lambda t: [(np.searchsorted(keys[n - 1], t.get(n, none)[0]).astype(np.int32), t.get(n, none)[1]) for n in range(1, order + 1)]
    return CharModels(keys, {k: placed(t) for k, t in g.items()}, {k: placed(t) for k, t in w.items()}, {k: float(w[k][0][1][0] - np.log(len(t[1][0]) + 1)) for k, t in g.items()})


def perplexity_of(column: pa.Array, lang: np.ndarray, models: CharModels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: symbols, perplexity a symbol (nan without a model or without words), and the largest log ratio of toxic to trusted likelihood of any word (nan likewise)."""
    words = split_words(column)
    n_texts = len(words.first) - 1
    text = words.text_of()
    total, size, worst = np.full(n_texts, np.nan), np.zeros(n_texts, np.int64), np.full(n_texts, np.nan)
    for name in np.unique(lang):
        mine = lang == name
        at = np.flatnonzero(mine[text])
        if not len(at):
            continue
        _, lead, inverse = np.unique(words.hash[at], return_index=True, return_inverse=True)
        lead = at[lead]
        joined = BEGIN + (END + BEGIN).join(bytes(words.data[s:e]).decode("utf-8", "replace") for s, e in zip(words.start[lead], words.end[lead])) + END
        symbols = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(symbols == ord(BEGIN)) if joined.count(BEGIN) == len(lead) else None
        if begins is None:  # a text holds the mark itself: take lengths word by word
            length = np.array([len(bytes(words.data[s:e]).decode("utf-8", "replace")) + 2 for s, e in zip(words.start[lead], words.end[lead])])
            begins = np.cumsum(length) - length
        length = np.diff(np.append(begins, len(symbols)))
        depth = np.arange(len(symbols)) - np.repeat(begins, length)
        size[mine] = np.bincount(text[at], weights=(length - 1)[inverse], minlength=n_texts).astype(np.int64)[mine]
        places = models.places(symbols)

        def of_words(model: str) -> np.ndarray:
            logp = models.score(model, places, depth)
            logp[begins] = 0
            return np.add.reduceat(logp, begins)

        if name in models:
            total[mine] = np.bincount(text[at], weights=of_words(name)[inverse], minlength=n_texts)[mine]
        if POOL in models and TOXIC in models:
            most = np.full(n_texts, -np.inf)
            np.maximum.at(most, text[at], (of_words(TOXIC) - of_words(POOL))[inverse])
            worst[mine] = np.where(np.isfinite(most), most, np.nan)[mine]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return size, np.where(size > 0, np.exp(-total / size), np.nan), worst


SCORED = "n_symbols long, perplexity double, worst_word double"


def _own(docs: DataFrame, text: str, lang: str, keys: tuple[str, ...]) -> DataFrame:
    return docs.select(F.struct(*keys).alias("key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))


def score_documents(docs: DataFrame, models: CharModels, text: str, lang: str, keys: tuple[str, ...]) -> DataFrame:
    """`keys`, lang, n_symbols, perplexity and worst_word (null without a model for the language or without words)."""
    own = _own(docs, text, lang, keys)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for b in batches:
            for lo, hi in texts_in_blocks(b.column(2)):
                part = b.slice(lo, hi - lo)
                size, *values = perplexity_of(part.column(2), part.column(1).to_numpy(zero_copy_only=False), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), *[pa.array(v, mask=np.isnan(v)) for v in values]], names=["key", "lang", "n_symbols", "perplexity", "worst_word"])

    return own.mapInArrow(score, with_key(own.schema["key"].dataType, f"lang string, {SCORED}")).select("key.*", "lang", "n_symbols", "perplexity", "worst_word")


def score_by_joins(docs: DataFrame, grams: DataFrame, contexts: DataFrame, order: int, text: str, lang: str, keys: tuple[str, ...]) -> DataFrame:
    """As `score_documents`, from count tables of any size: distinct words meet the sharded tables in joins.

    Every symbol of every distinct word takes the probability of the longest n-gram that ends there
    and was counted, and the weights of the longer contexts that were seen.
    """
    own = cut_lineage(_own(docs, text, lang, keys).withColumn("row", F.monotonically_increasing_id()))
    said = cut_lineage(own.select("row", "lang", F.explode(space_words(F.col("text"))).alias("word")).groupBy("row", "lang", "word").agg(F.count("*").alias("times")))
    distinct = said.select("lang", "word").distinct()
    asked = distinct.withColumn("model", F.explode(F.array("lang", F.lit(POOL), F.lit(TOXIC)))).withColumn("s", F.concat(F.lit(BEGIN), "word", F.lit(END)))
    ends = asked.select("lang", "word", "model", F.posexplode(F.transform(F.sequence(F.lit(2), F.length("s")), lambda e: F.transform(F.sequence(F.lit(1), F.least(e, F.lit(order))), lambda n: F.struct(
        n.alias("n"), F.substring(F.col("s"), e - n + 1, n).alias("gram"))))).alias("place", "g"))
    each = ends.select("lang", "word", "model", "place", F.explode("g").alias("g")).select("lang", "word", "model", "place", "g.n", "g.gram", F.expr("substring(g.gram, 1, g.n - 1)").alias("context"))
    unseen = contexts.where("n = 1").select(F.col("lang").alias("model"), "logw").join(grams.where("n = 1").groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("types")), "model").select("model", (F.col("logw") - F.log(F.col("types") + 1)).alias("unseen"))
    met = each.join(grams.withColumnRenamed("lang", "model"), ["model", "n", "gram"], "left").join(contexts.withColumnRenamed("lang", "model"), ["model", "n", "context"], "left")
    best = met.groupBy("lang", "word", "model", "place").agg(F.max(F.when(F.col("logp").isNotNull(), F.struct("n", "logp"))).alias("top"), F.collect_list(F.when(F.col("n") > 1, F.struct("n", "logw"))).alias("w"))
    weight = F.aggregate(F.filter("w", lambda x: x["n"] > F.coalesce(F.col("top.n"), F.lit(1))), F.lit(0.0), lambda acc, x: acc + F.coalesce(x["logw"], F.lit(0.0)))
    symbol = best.join(unseen, "model").select("lang", "word", "model", (F.coalesce("top.logp", "unseen") + weight).alias("p"))
    scored = symbol.groupBy("lang", "word").agg(*[F.sum(F.when(F.col("model") == m, F.col("p"))).alias(c) for m, c in ((F.col("lang"), "own"), (F.lit(POOL), "pool"), (F.lit(TOXIC), "bad"))])
    size = F.col("times") * (F.length("word") + 1)
    out = said.join(scored, ["lang", "word"], "left").groupBy("row").agg(F.sum(size).alias("n_symbols"), F.exp(-F.sum(F.col("own") * F.col("times")) / F.sum(size)).alias("perplexity"), F.max(F.col("bad") - F.col("pool")).alias("worst_word"))
    return own.join(out, "row", "left").select("key.*", "lang", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), "perplexity", "worst_word")


def judge_documents(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = ORDER,
                    quantile: float = QUANTILE, margin: float = MARGIN, worst_margin: float = WORST_MARGIN, most_grams: int = MOST_GRAMS) -> DataFrame:
    """key, lang, n_symbols, perplexity, threshold, worst_word, worst_threshold, kept; one row per input row.

    Trusted rows are labelled quality 1 and not toxic; all of them but the held-out fifth of each
    language, and all rows labelled toxic, fit the models. A language's thresholds are `margin` times
    the `quantile` of the perplexities, and `worst_margin` times that of the worst words, of all its
    held-out rows. Rows at or under both are kept, as are rows that have no value (no trusted text in their
    language, no toxic labels, no words: nothing speaks against them). A null language counts as '',
    repeated rows are judged each, an empty table gives an empty result, texts are read whole.
    Models of more than `most_grams` n-grams are not sent to tasks but joined.
    """
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    ids = labelled_ids(plain, labels, "key")
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    said = plain.join(ids, plain["key"] == ids["_id"]).where("part > 0").select(F.when(F.col("toxic") == 1, TOXIC).otherwise(F.col("lang")).alias("lang"), F.explode(space_words(F.col("text"))).alias("word"))
    raw = gram_counts(said.groupBy("lang", "word").agg(F.count("*").alias("times")), order)
    models_of = F.when(F.col("lang") == TOXIC, F.array("lang")).otherwise(F.array("lang", F.lit(POOL)))
    raw = raw.withColumn("lang", F.explode(models_of)).groupBy("lang", "n", "gram").agg(F.sum("raw").alias("raw"))
    grams, contexts = map(cut_lineage, smoothed(raw, order))
    if grams.count() <= most_grams:
        scored = score_documents(plain, collect_models(grams, contexts, order), "text", "lang", ("key",))
    else:
        scored = score_by_joins(plain, grams, contexts, order, "text", "lang", ("key",))
    scored = cut_lineage(scored)
    held = scored.join(ids.where("part = 0 and toxic = 0"), scored["key"] == ids["_id"])
    limits = held.select("lang").distinct().join(quantiles(held, "lang", "perplexity", quantile, "p"), "lang", "left").join(quantiles(held, "lang", "worst_word", quantile, "w"), "lang", "left").select("lang", (F.col("p") * margin).alias("threshold"), (F.col("w") * worst_margin).alias("worst_threshold"))
    limits = limits.withColumn("worst_threshold", F.greatest("worst_threshold", F.lit(0.0)))
    under = lambda value, limit: F.coalesce(F.col(value) <= F.col(limit), F.lit(True))
    return scored.join(F.broadcast(limits), "lang", "left").select(F.col("key").alias(key), "lang", "n_symbols", "perplexity", "threshold", "worst_word", "worst_threshold",
                                                                          (under("perplexity", "threshold") & under("worst_word", "worst_threshold")).alias("kept"))
