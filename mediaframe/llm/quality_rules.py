"""Quality rules as a short-circuit cascade of column expressions."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from mediaframe.llm.sqltext import let, space_words


Measures = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """`rejects` gives a boolean column from `measures()`; null means no rejection. `cost` is the work of
    deciding it for one text, in characters looked at, as SQL over `chars` and `n_words`; `reads` are the
    measures that this work goes into. Where all of them are taken anyway, the rule is one comparison."""
    name: str
    rejects: Callable[[Measures], Column]
    cost: str
    reads: tuple[str, ...] = ("text",)


#: The rules of the base verdict.
BASE = (
    Rule("few_words", lambda m: m["n_words"] < 50, "1", ("n_words",)),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], "12 * n_words * log2(n_words + 2)", ("n_repeat_words",)),
)
#: Beside the two base rules. A text must be far off what prose looks like in any of the four languages.
RULES = (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"], "3 * chars", ("n_symbols",)),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]), "chars + n_words", ("word_chars",)),
    Rule("repeated_lines", lambda m: (m["n_lines"] > 3) & (2 * m["n_dup_lines"] > m["n_lines"]), "2 * chars", ("n_lines", "n_dup_lines")),
    Rule("capitals", lambda m: 2 * F.length(F.regexp_replace(m["text"], "[^A-Z]+", "")) > F.length(m["text"]), "4 * chars"),
    Rule("shouting", lambda m: 4 * (F.length(m["text"]) - F.length(F.replace(m["text"], F.lit("!!"), F.lit("!")))) > m["n_words"], "chars"),
)


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window whose words stand at two or more places of the text.

    Windows are told apart by 64-bit hashes first: where all differ, none repeats. Otherwise they
    are sorted by hash, and equal neighbours are compared word by word; the places of the repeated
    ones, in order, then cover min(3, distance to the next) words each.
    """
    at = lambda w, i: F.get(w, i)
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)))

    def repeated(w: Column, s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            y = F.get(s, k)
            i, j = x["i"], y["i"]
            return F.coalesce((x["h"] == y["h"]) & (at(w, i) == at(w, j)) & (at(w, i + 1) == at(w, j + 1)) & (at(w, i + 2) == at(w, j + 2)), F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")), lambda acc, i: F.struct(
            (acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end")), lambda acc: acc["n"])

    def counted(w: Column, h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, lambda s: let(repeated(w, s), covered)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes(w), lambda h: counted(w, h))))


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def measures(text: Column, words: Column) -> Measures:
    """What rules look at; each is computed only where it is asked for."""
    joined = F.array_join(words, "")
    return {
        "text": text,
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _dup_lines(text),
        "n_repeat_words": _repeat_words(words),
        "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
    }


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(worded: DataFrame, rules, sample_rows: int = 2000, taken: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejection per cost, best first; `worded` has `text`, `_words` and keys, `taken` names the measures that are there in any case.

    Each rule's cost and what it rejects are estimated on the `sample_rows` rows of the smallest
    hashes in the whole table, so the order does not depend on how the rows lie. After each choice
    the rest is judged by the rows that are still left. The verdict is the same in any order; only
    the work before the first rejection changes.
    """
    n = worded.count()
    h = F.pmod(F.xxhash64(*_hashable(worded.drop("_words"))), F.lit(1 << 30))
    m = measures(F.col("text"), F.col("_words"))
    near = worded.where(h < int(min(1.0, 2 * (sample_rows + 50) / max(n, 1)) * (1 << 30)))  # about twice the rows wanted
    sized = near.select("text", "_words", h.alias("h"), F.length("text").alias("chars"), m["n_words"].alias("n_words"))
    rows = sized.select("h", *[F.coalesce(r.rejects(m), F.lit(False)) for r in rules], *[F.expr("1" if set(r.reads) <= set(taken) else r.cost).cast("double") for r in rules]).orderBy("h").limit(sample_rows).collect()  # numbers only
    left, out, rest = [r[1:] for r in rows], [], list(range(len(rules)))
    while rest:
        cost = {i: 1 + sum(r[len(rules) + i] for r in left) / max(1, len(left)) for i in rest}
        best = min(rest, key=lambda i: (-sum(r[i] for r in left) / max(1, len(left)) / cost[i], cost[i], rules[i].name))
        out.append(rules[best])
        rest.remove(best)
        left = [r for r in left if not r[best]]
    return out


def _hashable(df: DataFrame) -> list[Column]:
    """Columns, and fields of structs, that Spark can hash."""
    fields = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    fields = [(c[g.name], g.dataType) for c, t in fields if isinstance(t, StructType) for g in t] + [(c, t) for c, t in fields if not isinstance(t, StructType)]
    return [c for c, t in fields if not any(x in t.simpleString() for x in ("map<", "variant"))]


def _worded(docs: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    plain = docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.withColumn("_words", space_words(F.col("text")))


def _first_failed(rules: list[Rule], m: Measures, given: Column | None = None) -> Column:
    """Name of the first rule that rejects (null: none does). A branch is only looked at if all before it failed."""
    verdict = given
    for r in rules:
        verdict = (F if verdict is None else verdict).when(r.rejects(m), F.lit(r.name))
    return F.lit(None).cast("string") if verdict is None else verdict


def apply_rules(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules=RULES,
                sample_rows: int = 2000) -> DataFrame:
    """`keys`, the measures, base_failed, kept, failed_rule ('base' or the first of the ordered cascade; null if kept).

    One row per input row, repeated rows included; other columns are not read. A null text has
    no words, and so fails the base rule; an empty table gives an empty result; texts of any length
    are measured whole. Rules that tie are taken by lower cost, then by name. The base measures are
    returned, so all of them are taken and cost the further rules nothing; these run only for rows that pass the base.
    """
    worded, known = _worded(docs, text, keys), (*REPORTED, "n_lines")
    ordered = order_rules(worded, rules, sample_rows, known)
    m = measures(F.col("text"), F.col("_words"))
    measured = worded.select(*keys, "text", *[m[n].alias(n) for n in known])
    taken = {n: F.col(n) for n in m}
    failed = BASE[0].rejects(taken) | BASE[1].rejects(taken)
    judged = measured.withColumn("failed_rule", _first_failed(ordered, taken, F.when(failed, F.lit("base"))))
    return judged.select(*keys, *REPORTED, failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"), "failed_rule")


def keep_good(docs: DataFrame, text: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of `docs`, all columns as they are, that `apply_rules` keeps.

    Base rules take part in the cascade, and a row's measures are computed only up to the first
    rule that rejects it. Nulls, empty tables and repeated rows are treated as by `apply_rules`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    worded = _worded(docs.select(row.alias("_row"), F.col(text).alias("_text")), "_text", ("_row",))
    ordered = order_rules(worded.select("_row", "text", "_words"), (*BASE, *rules), sample_rows)
    failed = _first_failed(ordered, measures(F.col("text"), F.col("_words")))
    # A filter would be pushed below the projection and repeat the split in each of its terms; an exploded
    # array of one element or none is not.
    return worded.select("_row", F.explode(F.when(failed.isNull(), F.array(F.lit(1)))).alias("_one")).select("_row.*")
