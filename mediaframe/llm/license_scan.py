"""Licence texts found by a positional index of their rare words."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.llm.license_texts import PASSAGES
from mediaframe.llm.sqltext import LOWER, UPPER, alnum_words, let

#: Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def _padded(words: Column) -> Column:
    """Words set off by one blank on each side and doubled between, so that neighbours share none."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def _place(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def _starts(padded: Column, phrase: str) -> Column:
    """Word numbers at which a phrase begins (array<int>)."""
    before = F.split(padded, _place(phrase), -1)
    n = len(phrase.split(" "))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    walk = F.aggregate(F.slice(before, 1, F.size(before) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), lambda acc, s: F.struct(
        (acc["at"] + (spaces(s) / 2).cast("int") + n).alias("at"), F.array_append(acc["found"], acc["at"] + (spaces(s) / 2).cast("int")).alias("found")), lambda acc: acc["found"])
    return F.when(F.contains(padded, F.lit(_place(phrase))), walk).otherwise(F.array().cast("array<int>"))


def _listed(rows: list[Column], kind: str) -> Column:
    return F.array(*rows).cast(kind)


def template_words(passage: str) -> list[str]:
    """Words of a passage as `alnum_words` cuts them."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", passage.translate(str.maketrans(UPPER, LOWER)))


def rare_index(docs: DataFrame, text: str, templates, rare_words: int) -> list[list[str]]:
    """Of each template: its words of highest IDF, by document frequencies over all of `docs` (then by word)."""
    words = [sorted(set(template_words(passage))) for _, passage, _ in templates]
    vocabulary = _listed([F.lit(w) for w in sorted(set().union(*words))], "array<string>")
    # One row per licence word at most: the templates bound what comes to the driver.
    seen = docs.select(F.explode(F.array_intersect(alnum_words(F.col(text)), vocabulary)).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in seen}
    return [sorted(w, key=lambda x: (found.get(x, 0), x))[:rare_words] for w in words]


def _votes(words: Column, has: Column, terms: Column, postings: Column, templates: int) -> Column:
    """array<int>: for each template, how many different rare words at most agree on one relative position (0 below three).

    `has` are the indexed words that the text has, `postings` the places of each of `terms`.
    """
    def met(own: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(has, w).cast("int").alias("k"), i.alias("i"))), lambda x: x["k"] > 0)
        return F.array_sort(F.flatten(F.transform(hits, lambda x: F.transform(F.get(own, x["k"] - 1), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("shift"), x["k"].alias("k"))))))

    def count(acc: Column, x: Column) -> Column:
        here = (acc["t"] == x["t"]) & (acc["shift"] == x["shift"])
        n = F.when(here, acc["n"] + (acc["k"] != x["k"]).cast("int")).otherwise(F.lit(1))
        best = F.when((n >= 3) & (n > F.get(acc["best"], x["t"])), F.transform(acc["best"], lambda b, i: F.when(i == x["t"], n).otherwise(b))).otherwise(acc["best"])
        return F.struct(x["t"].alias("t"), x["shift"].alias("shift"), x["k"].alias("k"), n.alias("n"), best.alias("best"))

    begin = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("shift"), F.lit(0).alias("k"), F.lit(0).alias("n"), F.array_repeat(F.lit(0), templates).alias("best"))
    own_postings = F.transform(has, lambda h: F.get(postings, F.array_position(terms, h).cast("int") - 1))
    return let(own_postings, lambda own: F.aggregate(met(own), begin, count, lambda acc: acc["best"]))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=PASSAGES, rare_words: int = 8, min_share: float = 0.6) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row.

    Base places are exact. Beyond them the `rare_words` words of highest IDF of each template make up
    a positional index (word -> template, place). Where three or more of them stand in a text, its
    words are met with the postings and vote for the relative position of a template; a template is
    labelled when at least `min_share` of its indexed words that the text has, and three at least,
    agree, and its key phrase stands in the text. `score` is the best such share, 1 for a base
    place, else 0. Null and empty texts have no words, no labels ('') and null first and last words;
    an empty table gives an empty result; repeated rows are judged each; words of equal frequency
    are taken in the order of their letters. A text is judged whole, inside its row: nothing but
    the counts of licence words is shuffled.
    """
    indexed = rare_index(docs, text, templates, rare_words)
    named = sorted(set().union(*indexed))
    terms = _listed([F.lit(w) for w in named], "array<string>")
    posts: dict[str, list[tuple[int, int]]] = {w: [] for w in named}
    for t, (_, passage, _) in enumerate(templates):
        for i, w in enumerate(template_words(passage)):
            if w in indexed[t]:
                posts[w].append((t, i))
    postings = _listed([F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("at")) for t, i in posts[w]]) for w in named], "array<array<struct<t:int,at:int>>>")
    of_template = _listed([F.array(*map(F.lit, w)) for w in indexed], "array<array<string>>")
    label_of, phrase_of = (_listed([F.lit(x) for x in column], "array<string>") for column in ([label for label, _, _ in templates], [_place(phrase) for _, _, phrase in templates]))

    def found(w: Column, padded: Column, has: Column) -> Column:
        """array<struct<label, share>> of the templates that hold."""
        share = lambda n, t: F.when(n > 0, n / F.size(F.array_intersect(F.get(of_template, t), has)))
        shares = F.transform(_votes(w, has, terms, postings, len(templates)), lambda n, t: F.struct(F.get(label_of, t).alias("label"), share(n, t).alias("share"), t.alias("t")))
        good = F.filter(shares, lambda x: (x["share"] >= min_share) & F.contains(padded, F.get(phrase_of, x["t"])))
        return F.when(F.size(has) >= 3, good).otherwise(F.array().cast("array<struct<label:string,share:double,t:int>>"))

    def judged(w: Column) -> Column:
        return let(_padded(w), lambda p: F.struct(
            F.size(w).cast("long").alias("n_words"),
            *[_starts(p, phrase).alias(f"b{i}") for i, (phrase, _) in enumerate(PHRASES)],
            let(F.array_intersect(w, terms), lambda has: found(w, p, has)).alias("more")))

    places = F.concat(*[F.col(f"_j.b{i}") for i in range(len(PHRASES))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"_j.b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return docs.select(F.col(key).alias("key"), let(alnum_words(F.col(text)), judged).alias("_j")).select(
        F.col("key").alias(key), F.col("_j.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("_j.more", lambda x: x["label"]))).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_j.more", lambda x: x["share"])), F.lit(0.0))).alias("score"))
