"""Longest pieces by trie and by joins, against a walk letter by letter."""
import random

import pyarrow as pa
import pytest

from mediaframe.operators.tokens import Trie, tokenize_corpus


def cut(word, vocab):
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocab), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_trie_equals_a_walk():
    r = random.Random(3)
    for letters, size in (("ab", 12), ("abcé漢😀", 40), ("a", 3)):
        vocab = {"".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(size)} | {"a"}
        words = ["".join(r.choice(letters + "x") for _ in range(r.randint(0, 14))) for _ in range(400)] + ["a" * 5000, ""]
        assert Trie.of(sorted(vocab)).pieces(pa.array(words)).tolist() == [cut(w, vocab) for w in words]
    assert Trie.of([]).pieces(pa.array(["a", ""])).tolist() == [-1, 0]


@pytest.mark.parametrize("most", [1000, 0])
def test_both_ways_of_a_report(spark, most):
    long = "x" * 40
    vocab = ["play", "ing", "i", ",", "漢", long, long + "y", "é", "é"]
    texts = ["Playing, played 漢字", long + "y" + long, "i" * 100, "É É play", None, " \n", "", long * 3]
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    tokens, rates = tokenize_corpus(docs, spark.createDataFrame([(p,) for p in vocab + vocab], "piece string"), 5, most)
    assert sorted((r.doc_id, r.tokens, r.truncated) for r in tokens.collect()) == [(0, 6, True), (1, 2, False), (2, 100, True), (3, 3, False), (7, 3, False)]
    assert {(r.lang, r.words, r.unknown_rate) for r in rates.collect()} == {("de", 6, round(2 / 6, 6)), ("en", 5, 0.0)}
