"""The pipeline's stages, written and read again, against a brute-force version."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from mediaframe.llm import packing
from tests.llm.test_rules_and_scans import alnum
from tests.llm.test_simhash import fingerprint
from tests.llm.test_substring_dedup import brute as without_repeats


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    passage, item = " ".join(word() for _ in range(55)), " ".join(word() for _ in range(16))
    rows = []
    for i in range(40):
        body = " ".join(word() for _ in range(r.randint(55, 160)))
        rows.append((i, body + (" " + passage if i % 9 == 0 else "") + (" " + item if i % 11 == 3 else "")))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, rows[6][1] + " end"), (103, "too short"), (104, None), (105, "SHOUT!! " * 80), (106, "same words here " * 40)]
    words = rows[1][1].split()
    rows += [(107, " ".join([*words[:-1], "changed", "and", "more"])), (108, " ".join(word() if k % 10 == 5 else w for k, w in enumerate(words)))]  # a near copy, and one that is not
    return rows, [(1, item), (2, "unseen item " * 9)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_copies(texts):
    """Numbers of groups over links of Jaccard similarity 0.8 or more between sets of five-word shingles."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a == b or 5 * len(a & b) >= 4 * len(a | b)) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_the_corpus_tells_the_similarity_from_fingerprint_bits():
    by = dict(corpus()[0])
    assert near_copies([by[1], by[107]]) == [0, 0] and near_copies([by[1], by[108]]) == [0, 1]
    assert (fingerprint(by[1]) ^ fingerprint(by[107])).bit_count() > 2


def expected(rows, items):
    keep = []
    for i, t in rows:
        t = t or ""
        w = t.split()
        seen = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
        rep = {a + k for a in range(len(w) - 2) if seen[tuple(w[a : a + 3])] > 1 for k in range(3)}
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        chars = sum(map(len, w))
        lines = [x for x in t.split("\n") if x.split()]
        dup = len(lines) - len(set(lines))
        bad = (len(w) < 50 or 100 * len(rep) > 50 * len(w) or symbols > 0.1 * len(w) or not 2 * len(w) <= chars <= 25 * len(w)
               or (2 * dup > t.count("\n") + 1 > 3) or 2 * len(re.findall("[A-Z]", t)) > len(t) or 4 * (len(t) - len(t.replace("!!", "!"))) > len(w))
        if not bad:
            keep.append((i, t))
    group = near_copies([t for _, t in keep])
    least = {g: min(i for (i, _), h in zip(keep, group) if h == g) for g in group}
    keep = [(i, t) for (i, t), g in zip(keep, group) if least[g] == i]
    left = {int(k): (gone, text) for k, _, gone, text in without_repeats(keep, 35)}
    keep = [(i, left[i][1] if left[i][0] else t) for i, t in keep]
    clean = []
    for i, t in keep:
        w, hit = alnum(t), set()
        for _, x in items:
            x = alnum(x)
            for a in range(len(x) - 12):
                hit |= {s + k for s in range(len(w) - 12) if w[s : s + 13] == x[a : a + 13] for k in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((i, t))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text in clean:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        out += [(i, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for p, (s, n) in enumerate(packing.cut_pieces(len(ids)))]
    return sorted(out), len(clean)


def test_stages(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = at.columns
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert at.columns == columns
    want, n = expected(rows, items)
    assert 20 < n < 40
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in at.collect()) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)


def test_each_stage_runs_once(spark, tmp_path, monkeypatch):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    told = []

    def counted(name, stage):
        rows_out, held = spark.sparkContext.accumulator(0), []
        told.append((rows_out, held))

        def run(s, docs, sf_dir):
            def tell(batches):
                for b in batches:
                    rows_out.add(b.num_rows)
                    yield b

            out = stage(s, docs, sf_dir)
            held.append(out)
            return out.mapInArrow(tell, out.schema)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*x) for x in corpus_pipeline.STAGES])
    final = len(corpus_pipeline.run(spark, str(tmp_path)).collect())
    seen = [n.value for n, _ in told]
    assert seen[-1] == final and seen[:-1] == [held[0].count() for _, held in told[:-1]]
