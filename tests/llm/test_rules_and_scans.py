"""Quality rules, licence scans, URL filters and decontamination against brute force."""
import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mediaframe.llm import decontamination, license_scan, quality_rules, url_filter
from tests.llm.fixtures import documents, texts

LICENCES = [
    "CC BY 4.0 and again cc\nby-nc; x", "the General  Public License, all rights reserved", "All Rights Reserved. cc by cc by",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit license words alone said: the files of this software", "ccby c by", "éCC BY", "",
]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def test_quality_measures(spark):
    rows = list(enumerate(texts())) + [(None, "x y z x y z"), (2, "a\n\na\n b\n b\n \n \nc"), (7, "a a a a a"), (8, "Ω# <b> |")]
    got = quality_rules.apply_rules(documents(spark, rows), sample_rows=20)
    want = []
    for key, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((str(key), len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    rows_ = got.collect()
    assert sorted((str(r.doc_id), *r[1:7]) for r in rows_) == sorted(want)
    assert all(not r.kept for r in rows_ if r.base_failed) and all(r.kept == (r.failed_rule is None) for r in rows_)


def test_quality_order_leaves_the_verdict(spark):
    docs = documents(spark)
    a = quality_rules.apply_rules(docs, rules=quality_rules.RULES).select("doc_id", "kept").collect()
    b = quality_rules.apply_rules(docs, rules=quality_rules.RULES[::-1], sample_rows=1).select("doc_id", "kept").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in a)
    assert quality_rules.keep_good(documents(spark, [])).count() == 0


def test_quality_order_follows_rows_not_their_layout(spark):
    rows = [(i, f"line {i} of plain words\n" * 30) for i in range(300)] + [(1000 + i, "### $$$ %%% " * (30 + i)) for i in range(300)] + [(2000 + i, "SHOUT LOUD " * 40 + str(i)) for i in range(100)]
    orders = set()
    for part in (1, 7):
        for listed in (rows, rows[::-1]):
            worded = quality_rules._worded(documents(spark, listed).repartition(part), "text", ("doc_id",))
            orders.add(tuple(r.name for r in quality_rules.order_rules(worded, (*quality_rules.BASE, *quality_rules.RULES), 150)))
    assert len(orders) == 1 and len(orders.pop()) == 7
    held = documents(spark, rows[:20]).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    assert quality_rules.keep_good(held).columns == held.columns


def test_measures_that_are_taken_cost_nothing(spark):
    # Capitals reject twice as often as symbols, but read the text, which symbols do not where they are counted already.
    rows = [(i, "PLAIN LOUD WORDS " * 30 + str(i)) for i in range(200)] + [(1000 + i, f"a calm # and $ line of words {i} " * 20) for i in range(100)]
    worded = quality_rules._worded(documents(spark, rows), "text", ("doc_id",))
    order = lambda *taken: [r.name for r in quality_rules.order_rules(worded, quality_rules.RULES, 300, taken)]
    alone, beside = order(), order(*quality_rules.REPORTED, "n_lines")
    assert alone.index("capitals") < alone.index("symbols") and beside.index("symbols") < beside.index("capitals")
    assert sorted(alone) == sorted(beside)


def test_quality_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 70001}" for i in range(3_000_000))  # about 20 MB, all its words repeat in windows
    r = quality_rules.apply_rules(documents(spark, [(1, long), (2, "short")])).where("doc_id = 1").first()
    assert r.n_words == 3_000_000 and r.n_repeat_words == 3_000_000 and r.base_failed and not r.kept


def test_licences(spark):
    rows = list(enumerate(LICENCES + texts())) + [(None, "cc by"), (1, "cc by")]
    got = license_scan.scan_licenses(documents(spark, rows))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    by = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got.collect())
    want = []
    for key, t in rows:
        w, found, labels = alnum(t), [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            found += hits
            labels |= {label} if hits else set()
        want.append((str(key), len(w), len(found), str(min(found, default=None)), str(max(found, default=None)), ",".join(sorted(labels))))
    assert by == sorted(want)
    more = {r.doc_id: (r.labels, r.score) for r in got.collect() if r.doc_id in range(3, 7)}
    assert more[3][0] == "mit" and more[4][0] == "apache" and more[5] == ("mit", 1.0) and more[6] == ("", 0.0)
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


def slow_labels(texts_, templates, rare_words=8, min_share=0.6):
    """Labels beyond the base ones and the best share of each text."""
    words = [alnum(t) for t in texts_]
    passages = [(label, alnum(p), phrase.split()) for label, p, phrase in templates]
    seen = Counter(w for ws in words for w in set(ws))
    index = [sorted(set(p), key=lambda w: (seen[w], w))[:rare_words] for _, p, _ in passages]
    holds = lambda ws, p: any(ws[i : i + len(p)] == p for i in range(len(ws) - len(p) + 1))
    out = []
    for ws in words:
        labels, score = set(), 0.0
        for (label, p, phrase), rare in zip(passages, index):
            shifts = {}
            for i, w in enumerate(ws):
                for j, x in enumerate(p):
                    if w == x and w in rare:
                        shifts.setdefault(i - j, set()).add(w)
            agree = max(map(len, shifts.values()), default=0)
            of = len(set(rare) & set(ws))
            if agree >= 3 and agree / of >= min_share and holds(ws, phrase):
                labels.add(label)
                score = max(score, agree / of)
        out.append((labels, score))
    return out


def test_licence_labels_equal_brute_force(spark):
    r = random.Random(9)
    passages = [p for _, p, _ in license_scan.PASSAGES]
    made = []
    for _ in range(150):
        parts = [r.choice(passages) for _ in range(r.choice([0, 1, 1, 2, 4]))]
        parts = [" ".join(w for w in p.split() if r.random() > r.choice([0, 0, 0.1, 0.4])) for p in parts]
        filler = lambda: " ".join(r.choice(["alpha", "the", "software", "permission", "beta", "license", "this", "of"]) for _ in range(r.randint(0, 40)))
        made.append(filler() + "\n".join(f" {p}. {filler()}" for p in parts))
    rows = list(enumerate(made + LICENCES + [None, "x " * 10 + passages[5] + " y" * 9]))
    got = {x.doc_id: x for x in license_scan.scan_licenses(documents(spark, rows)).collect()}
    for (i, t), (labels, score) in zip(rows, slow_labels([t for _, t in rows], license_scan.PASSAGES)):
        base = set(filter(None, got[i].base_labels.split(",")))
        assert got[i].labels == ",".join(sorted(base | labels)), t
        assert abs(got[i].score - (1.0 if base else score)) < 1e-12, t
    assert len({x for row in got.values() for x in row.labels.split(",")}) >= 20
    for label, passage, phrase in license_scan.PASSAGES:
        assert " ".join(phrase.split()) in " ".join(alnum(passage)), (label, phrase)


def test_licences_of_a_very_long_text(spark):
    long = "permission is granted word " * 800_000 + "all rights reserved " + license_scan.PASSAGES[-2][1]  # about 20 MB
    got = license_scan.scan_licenses(documents(spark, [(1, long), (2, "x")])).where("doc_id = 1").first()
    assert got.n_words == len(alnum(long)) and got.base_labels == "reserved" and "zlib" in got.labels


def test_urls(spark):
    urls = ["https://Example.COM/en/x?y", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://example.com/de/", "http://x.net/es/1", "http://net/fr/", "http://net/frx",
            "http://badexample.com/en/", "http://example.com", "no scheme", None, "", "://", "a://b.com/x://c.net/es/", "http://x.com:80/", "http://U.NET?/es/", "http://É.net/es/#a", "h\n://y.com/a\nb", "http://x.net/es/" + "q" * 5_000_000]
    pages = spark.createDataFrame([(i % 16, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "x"), (3, urls[0], "x"), (3, urls[0], "x")], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]

    def judge(u):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = low(host)
        fits = [(len(h), len(p), v, h + p) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, "allow", None))
        return host, path, str(best[3]), best[2]

    want = sorted((str(r.page_id), *judge(r.url)) for r in pages.collect())
    for limit in (100_000, 0):  # broadcast or shuffled rules
        got = url_filter.judge_urls(pages, url_filter.rule_table(spark), max_broadcast_rules=limit)
        joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
        assert len(joins) == 1 and "digest" not in joins[0]  # the short hash alone is the key
        assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got.collect()) == want
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    none = url_filter.judge_urls(pages, url_filter.rule_table(spark).limit(0)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")} and len(none) == len(want)


def test_decontamination(spark):
    base = texts()
    items = [(1, " ".join(alnum(base[7])[3:25])), (2, "Alpha, beta gamma"), (10, base[8]), (10, "delta"), (None, "theta iota x"), (4, None), (5, "?!"), (6, " ".join(f"never{i}" for i in range(20)))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, key long")
    rows = list(enumerate(base)) + [(None, base[7]), (3, "alpha beta gamma"), (3, "alpha beta gamma")]
    want = []
    for key, t in rows:
        w, hit, found = alnum(t), set(), set()
        for item, it in items:
            x = alnum(it)
            n = min(13, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == x[a : a + n]:
                        hit |= set(range(s, s + n))
                        if item is not None:
                            found.add(str(item))
        want.append((str(key), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    docs = documents(spark, rows)
    for limit in (500_000, 0):
        got = decontamination.decontaminate(docs, bench, max_broadcast=limit)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == sorted(want)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert decontamination.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(documents(spark, []), bench).count() == 0


def test_decontamination_of_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = "word after word " * 1_250_000 + item  # about 20 MB
    bench = spark.createDataFrame([(1, item), (2, "unseen " * 30)], "item_id long, text string")
    got = decontamination.decontaminate(documents(spark, [(1, long), (2, item + " tail"), (3, None)]), bench)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == {1: (3_750_020, 20, 1, False), 2: (21, 20, 1, True), 3: (0, 0, 0, False)}
