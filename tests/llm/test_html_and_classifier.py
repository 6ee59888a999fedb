import html
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediaframe.llm import html_text, quality_classifier as qc
from tests.llm.fixtures import documents

PAGES = [
    ("<p>One <b>two<br>three<p>four &amp; five", "One two\nthree\n\nfour & five"),
    ("<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol><li>e</ul>after", "- a\n- b\n  3. c\n  4. d\n- e\n\nafter"),
    ("<table><tr><td>a<td>bbbb<tr><th>ccccc<td>d</table>", "a      bbbb\nccccc  d"),
    ("<table><tr><td rowspan=2>r<td>x</tr><tr><td>y</td></tr><tr><td colspan=2>wide wide<td>z</table>", "r  x\n   y\nwide wide  z"),
    ("<head><title>no</title></head><script>var t='</p>';</script><style>p{}</style><!-- no --><div hidden>no</div><div style='display: none'>no</div><div>yes</div>x", "yes\nx"),
    ("<pre>\n a\n   b</pre>c  \n d", " a\n   b\n\nc d".strip("\n")),
    ("a<details><summary>s</summary>hidden</details><details open><summary>t</summary>u</details>", "a\ns\nt\nu"),
    ("x < y & z <b", "x < y & z"), ("", ""), (None, ""), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"), ("<div>" * 5000 + "deep", "deep"),
    ('<p>a</p><p class="x"">HELLO</p><p>tail</p>', "a\n\nHELLO\n\ntail"), ("<p title=it's>HELLO</p><p>tail</p>", "HELLO\n\ntail"), ("<p>a<!-->b<!-- c --!>d", "abd"),
    ("<style>.h{display:none} @media print{.k{display:none}} p.z, #q{visibility:hidden}</style><p class='a h'>no</p><p class=k>yes</p><p class=z>no<b style='visibility:visible'>see</b></p><i id=q>no</i>t", "yes\n\nsee\n\nt"),
    ("<style>.h{display:none}.h.o{display:block}</style><div class='h o'>yes</div><div hidden style='display:block'>yes</div><dialog>no</dialog><dialog open>yes</dialog>", "yes\nyes\nyes"),
    ("<table><tr><td>" + "w" * 90 + "<td>b<tr><td>c<td>d</table>", "w" * 90 + "  b\nc" + " " * 91 + "d"),
    ("<p>a</p> <p>b</p>\n<h1>c</h1><div>d</div><div>e</div>", "a\n\nb\n\nc\n\nd\ne"), ("<li>loose<td>cell", "- loosecell"),
]


def test_pages(spark):
    for page, want in PAGES:
        assert html_text.visible_text(page) == want, page
    pages = spark.createDataFrame([(i, h, "k") for i, (h, _) in enumerate(PAGES)] + [(None, "<p>q", "k"), (0, "<p>r", "k")], "page_id long, html string, key string")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "text"]
    assert sorted((str(r.page_id), r.text) for r in got.collect()) == sorted([(str(i), t) for i, (_, t) in enumerate(PAGES)] + [("None", "q"), ("0", "r")])
    assert html_text.extract_text(pages.limit(0)).count() == 0


BLANK = " \t\n\r\f"


def slow_tokens(html):
    """Start tags, end tags and texts, character by character."""
    i, n = 0, len(html)
    while i < n:
        if html[i] != "<" or not (html[i + 1 : i + 2].isascii() and html[i + 1 : i + 2].isalpha() or html[i + 1 : i + 2] in ("!", "?") or html[i + 1 : i + 2] == "/" and i + 2 < n):
            if html[i + 1 : i + 2] == "" and html[i] == "<":
                yield "text", html[i]
                return
            yield "text", html[i]
            i += 1
            continue
        if html.startswith("<!--", i):
            i += 4
            body = ""
            while i < n and not (body in ("", "-") and html[i] == ">") and not body.endswith(("-->", "--!>")):
                body += html[i]
                i += 1
            i += i < n and body in ("", "-") and html[i] == ">"
            continue
        end = html[i + 1] == "/"
        j = i + 1 + end
        if not (html[j].isascii() and html[j].isalpha()):
            while j < n and html[j] != ">":
                j += 1
            i = j + 1
            continue
        name, attrs = "", {}
        while j < n and html[j] not in BLANK + "/>":
            name += html[j].lower()
            j += 1
        while j < n and html[j] != ">":
            if html[j] in BLANK + "/":
                j += 1
                continue
            key, value = html[j], ""
            j += 1
            while j < n and html[j] not in BLANK + "/>=":
                key += html[j]
                j += 1
            k = j
            while k < n and html[k] in BLANK:
                k += 1
            if k < n and html[k] == "=":
                j = k + 1
                while j < n and html[j] in BLANK:
                    j += 1
                if j < n and html[j] in "\"'":
                    quote = html[j]
                    j += 1
                    while j < n and html[j] != quote:
                        value += html[j]
                        j += 1
                    if j == n:
                        return
                    j += 1
                else:
                    while j < n and html[j] not in BLANK + ">":
                        value += html[j]
                        j += 1
            attrs.setdefault(key.lower(), value)
        if j >= n:
            return
        i = j + 1
        yield ("end", name) if end else ("start", name, attrs)
        if not end and name in html_text.RAW:
            j = i
            while j < n and not (html[j : j + 2 + len(name)].lower() == f"</{name}" and html[j + 2 + len(name) : j + 3 + len(name)] in tuple(BLANK + "/>")):
                j += 1
            yield "raw", html[i:j]
            while j < n and html[j] != ">":
                j += 1
            i = j + 1


def slow_tree(html):
    """(tag, attributes, children) by looking through the whole stack at every step."""
    root = ("html", {}, [])
    stack = [root]
    add = lambda name, attrs: (stack[-1][2].append(x := (name, attrs, [])), stack.append(x))

    def nearest(names, until):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in until:
                return None
            if stack[k][0] in names:
                return k

    def children_with(node, x):
        return node[2] if any(c is x for c in node[2]) else next((f for c in node[2] if isinstance(c, tuple) for f in [children_with(c, x)] if f is not None), None)

    def leave_blocks(k):
        """The blocks in the formatting element at k move out of it, at most eight, each into the one before."""
        name, attrs, around = *stack[k][:2], stack[k - 1]
        stack[k : k + 1] = []
        for _ in range(8):
            j = next((j for j in range(k, len(stack)) if stack[j][0] in html_text.BLOCKS), None)
            if j is None:
                return
            block, between = stack[j], stack[k:j]
            held = children_with(root, block)
            del held[next(i for i, c in enumerate(held) if c is block)]
            moved = block
            for x in reversed(between):
                moved = (x[0], x[1], [moved]) if x[0] in html_text.FORMATTING else moved
            around[2].append(moved)
            block[2][:] = [(name, attrs, list(block[2]))]
            stack[k:j] = []
            around, k = block, k + 1

    for kind, *t in slow_tokens(html):
        if kind == "text":
            stack[-1][2].append(t[0])
        elif kind == "raw":
            stack[-1][2].append(t[0])
            stack.pop()
        elif kind == "end":
            scope = html_text.SCOPES - {t[0]} if t[0] not in html_text.ACROSS else set()
            if t[0] == "p" and nearest({"p"}, html_text.SCOPES) is None:
                stack[-1][2].append(("p", {}, []))
            k = nearest({t[0]}, scope)
            inside = [x for x in stack[k + 1 :] if x[0] in html_text.BLOCKS] if k else []
            if inside and t[0] in html_text.FORMATTING:
                leave_blocks(k)
            elif not inside or t[0] in html_text.BLOCKS | html_text.SCOPES:
                del stack[k if k else len(stack) :]
        elif t[0] != "html":
            name, attrs = t
            if name in html_text.BLOCKS and name not in ("option", "optgroup"):
                k = nearest({"p"}, html_text.SCOPES)
                del stack[k if k else len(stack) :]
            if name in html_text.ENDS:
                names, until = html_text.ENDS[name]
                k = nearest(names, until)
                while k and k > 1 and stack[k - 1][0] in names:
                    k -= 1
                del stack[k if k else len(stack) :]
            if name == "tr" and stack[-1][0] == "table":
                add("tbody", {})
            if name in ("td", "th") and stack[-1][0] in ("table", "tbody", "thead", "tfoot"):
                if stack[-1][0] == "table":
                    add("tbody", {})
                add("tr", {})
            add(name, attrs)
            if name in html_text.VOID:
                stack.pop()
    return root


def plain(tag, attrs, children):
    """A tree as nested tuples with neighbouring strings joined."""
    out = []
    for c in children:
        c = c if isinstance(c, (str, tuple)) else (c.tag, c.attrs, c.children)
        if isinstance(c, tuple):
            out.append(plain(*c))
        elif out and isinstance(out[-1], str):
            out[-1] += html.unescape(c) if tag in html_text.RAW else c
        else:
            out.append(html.unescape(c) if tag in html_text.RAW else c)
    return tag, attrs, out


def slow_words(tag, attrs, children):
    """Visible text of a plain tree, hidden only by tag, attribute or its own style."""
    if tag in html_text.HIDDEN or "hidden" in attrs or tag == "dialog" and "open" not in attrs or "display:none" in attrs.get("style", ""):
        return ""
    if tag == "details" and "open" not in attrs:
        children = [c for c in children if isinstance(c, tuple) and c[0] == "summary"]
    return " ".join(html.unescape(c) if isinstance(c, str) else slow_words(*c) for c in children)


SOUP = ["<p>", "</p>", "<div class=\"x\"\">", "</div>", "<b title=it's>", "</b>", "<i hidden>", "</i>", "<em>", "</em>", "word ", "x<y ", "a&amp;b ", "<br>", "<br/>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "<td colspan='2'>", "</table>", "</td>", "<!-- c -->", "<!-->", "<!--x--!>",
        "<!doctype html>", "</>", "</ p>", "<?pi >", "<script>if(a<b){'</p>'}</script>", "<style>p{}</style >", "<textarea><p>t</textarea>", "<select><option>o", "</select>", "<dl><dt>", "<dd>", "</dl>", "<button>", "</button>", "<span hidden>", "</span>",
        "<i style='display:none'>", "</i>", "<details>", "<summary>", "</details>", "<a href=/x/y>", "<a b='>'c=\"<\" d>", "</a>", "<img =x>", "<p / q = 'r' s=>", "<thead>", "<caption>", "</tr>", "\n ", "<<", "é", "<1", "</html>", "<dialog open>", "</dialog>", "<title>t</title>"]


def test_parser_equals_slow_one(sf_pages=("/root/testdata/sf0.001/pages.parquet",)):
    r = random.Random(4)
    soup = ["".join(r.choice(SOUP) for _ in range(r.randint(1, 40))) + r.choice(["", "<", "<b", "</", "<b x='", "<!-- ", "<b x"]) for _ in range(4000)]
    pages = [h for path in sf_pages for (h,) in duckdb.sql(f"SELECT html FROM '{path}'").fetchall() if h]
    for page in soup + pages:
        root, _ = html_text.parse(page)
        want = plain(*slow_tree(page))
        assert plain(root.tag, root.attrs, root.children) == want, page
        cells = re.sub(r"(?m)^ *(?:- |\d+\. )", " ", html_text.visible_text(page)) if page in pages else html_text.visible_text(page)
        letters = lambda x: sorted("".join(c for c in x if c.isalpha()))
        assert letters(cells) == letters(slow_words(*want)), page
        if "<t" not in page and "<li" not in page:  # without cells side by side and list marks: in the order of the page
            assert "".join(filter(str.isalpha, cells)) == "".join(filter(str.isalpha, slow_words(*want))), page


@pytest.mark.parametrize("page,text", [
    ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"), ("<i hidden>x<p>y</i>z</p>w", "z\n\nw"), ("<b hidden>x<div>y<div>z</b>v</div>u</div>w", "v\nu\nw"),
    ("<span>a<p>b</span>c</p>d", "a\n\nbc\n\nd"), ("<b><i>a</b>b</i>c", "abc"), ("<a>1<div>2</a>3</div><a>4</a>", "1\n23\n4"), ("<ul><li><b>a<li>b</b>c</ul>d", "- a\n- bc\n\nd"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"), ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"),
    ("<table><tr><td>" * 10 + "<table><tr><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
])
def test_layouts_of_misnested_pages_and_lists(page, text):
    assert html_text.visible_text(page) == text


def test_hostile_pages_are_linear_and_whole():
    many = 100_000
    for page in ("<b><div>" * (many // 4) + "</b>" * (many // 4) + "x", "<b>" * (many // 4) + "<div>" * (many // 4) + "</b>" * (many // 4), "<div><b><i>" * (many // 8) + "</b>" * (many // 4) + "<option>" * (many // 4), "<li><b><p>" * (many // 8) + "</b></i>" * (many // 4), "<div>" * many + "x", "<ul><li>x" * (many // 4), "<b></p>" * many, "<a b='c' \"d" * many, "</script <" * many, "<script>" + "</script <" * many, "<table><tr><td>x" * (many // 20), "<div>" * many + "<option>x" * many, "<b>" * many + "</i>" * many):
        began = time.time()
        html_text.visible_text(page)
        assert time.time() - began < 8, page[:20]
    long = "<table>" + "<tr><td>a<td>" + "y" * 10_000_000 + "<tr><td>b" * 50_000
    assert html_text.visible_text("<p>" + "word " * 4_000_000) == ("word " * 4_000_000).strip()
    got = html_text.visible_text(long)
    assert got.count("y") == 10_000_000 and got.count("b") == 50_000 and len(got) < 2 * len(long)


def brute(words, order):
    """Interpolated modified Kneser-Ney over characters inside words."""
    raw = Counter()
    for w, times in words.items():
        s = qc.BEGIN + w + qc.END
        for e in range(1, len(s)):
            for n in range(1, min(e + 1, order) + 1):
                raw[s[e - n + 1 : e + 1]] += times
    kinds = Counter(g[1:] for g in raw if len(g) > 1)
    c = {g: r if len(g) == order or g[0] == qc.BEGIN else kinds.get(g, r) for g, r in raw.items()}
    d, types = {}, Counter(map(len, c))
    for n in range(1, order + 1):
        f = [sum(len(g) == n and x == i for g, x in c.items()) for i in range(5)]
        y = f[1] / (f[1] + 2 * f[2]) if f[1] + 2 * f[2] else None
        for i in (1, 2, 3):
            v = i - (i + 1) * y * f[i + 1] / f[i] if y is not None and f[i] else 0.5 * i
            d[n, i] = min(max(v, 0.05), i - 0.05)
    by = defaultdict(list)
    for g, x in c.items():
        by[len(g), g[:-1]].append((g, x))

    def p(g):
        if not g:
            return 1 / (types[1] + 1)
        followers = by.get((len(g), g[:-1]))
        if not followers:
            return p(g[1:])
        off = lambda x: d[len(g), min(x, 3)]
        total = sum(x for _, x in followers)
        own = next((x for h, x in followers if h == g), 0)
        return (own - off(own)) / total * (own > 0) + sum(off(x) for _, x in followers) / total * p(g[1:]) if own else sum(off(x) for _, x in followers) / total * p(g[1:])

    return p


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity_equals_brute_force(spark, order):
    words = Counter("the cat sat on the mat and a rat sat at the flat hat été ete".split())
    df = spark.createDataFrame([("en", w, t) for w, t in words.items()], "lang string, word string, times long")
    models = qc.collect_models(*qc.kneser_ney(df, order), order)
    p = brute(words, order)
    texts = ["the cat", "zzz hat éa", "", None, "t\u0002h the", "unseen\u6f22 flat the the"]
    size, got, worst = qc.perplexity_of(pa.array(texts), __import__("numpy").array(["en"] * len(texts), object), models)
    assert all(map(math.isnan, worst))
    for t, n, x in zip(texts, size, got):
        logs = []
        for w in (t or "").split():
            s = qc.BEGIN + w + qc.END
            logs += [math.log(p(s[max(0, e - order + 1) : e + 1])) for e in range(1, len(s))]
        assert n == len(logs)
        assert math.isnan(x) if not logs else x == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9), t


def test_judging_holds_out_and_keeps(spark):
    good = [(i, f"the cat number {i % 9} sat on the mat and the dog lay by the door of house {i % 7}", "en") for i in range(300)]
    bad = [(1000 + i, "XQZ!! #### %%% VVKJ!! QQ" * 4, "en") for i in range(20)]
    odd = [(5000, None, "en"), (5001, "", "en"), (5002, "quelque chose", "fr"), (5003, "x", None), (None, good[0][1], "en"), (7, good[7][1], "en")]
    docs = spark.createDataFrame([(*r, 0.0) for r in good + bad + odd], "doc_id long, text string, lang string, threshold double")
    labels = docs.where("doc_id < 300").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = qc.judge_documents(docs, labels).collect()
    assert len(got) == 326
    joined = qc.judge_documents(docs, labels, most_grams=0).collect()  # the same by joins
    near = lambda rows: sorted((str(r.doc_id), r.lang, r.n_symbols, f"{r.perplexity or 0:.6g}", f"{r.threshold or 0:.6g}", r.kept) for r in rows)
    assert near(joined) == near(got)
    kept = defaultdict(list)
    for r in got:
        kept["bad" if r.doc_id and 1000 <= r.doc_id < 2000 else "odd" if r.doc_id and r.doc_id >= 5000 else "good"].append(r.kept)
    assert not any(kept["bad"]) and all(kept["odd"]) and all(kept["good"])
    assert qc.judge_documents(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in qc.judge_documents(docs, labels.limit(0)).collect())


def test_toxic_words_are_caught(spark):
    """Held-out rows: one word of abuse in ordinary text is enough, the ordinary text passes."""
    r = random.Random(6)
    syllables = ["an", "the", "er", "ing", "on", "ti", "ou", "re", "st", "ble"]
    prose = lambda: [("".join(r.choice(syllables) for _ in range(r.randint(1, 4)))) for _ in range(r.randint(30, 300))]
    rows = []
    for i in range(1500):
        words = prose()
        toxic = i % 5 == 0
        for _ in range(r.choice([1, 2, 5]) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["vulgrak", "dumpfek", "mukzip"]))
        rows.append((i, " ".join(words), "en" if i % 3 else "de", int(toxic)))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], 1, x[3]) for x in rows if x[0] < 900] + [(5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for options in ({}, {"most_grams": 0}):
        kept = {x.doc_id: x.kept for x in qc.judge_documents(docs, labels, **options).collect()}
        late = [x for x in rows if x[0] >= 900]
        assert len(kept) == len(rows) and not any(kept[x[0]] for x in late if x[3])
        assert sum(kept[x[0]] for x in late if not x[3]) >= 0.97 * sum(not x[3] for x in late)


def test_all_labelled_rows_are_used(spark):
    """More labels than 2000 of a language: none is left out, and abuse that only the last by hash name is known."""
    ids = spark.range(6000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).orderBy("h", "doc_id").collect()
    place = {r.doc_id: i for i, r in enumerate(ids)}
    rows = [(i, "the cat sat on the mat" + (" zvulgrakz" if i % 2 and place[i] >= 5500 else f" by house {i % 50}"), "en") for i in range(6000)]
    usual = "the cat sat on the mat by house 8 " * 30
    docs = spark.createDataFrame(rows + [(9000, usual + "zvulgrakz", "en"), (9001, usual, "en")], "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 6000").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    parts = Counter((r.toxic, r.part) for r in qc.labelled_ids(docs, labels, "doc_id").collect())
    assert sum(parts.values()) == 6000 and parts[1, 1] == 3000 and all(parts[0, p] == 600 for p in range(5))
    kept = {r.doc_id: r.kept for r in qc.judge_documents(docs, labels).collect()}
    assert len(kept) == 6002 and not kept[9000] and kept[9001]


def test_quantiles_are_exact(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(g, r.choice([None, r.random(), 0.5])) for g in "ab" for _ in range(501)] + [("c", 2.0), ("d", None)], "g string, v double")
    for q in (0.0, 0.37, 0.99, 1.0):
        got = {x.g: x.v for x in qc.quantiles(df, "g", "v", q, "v").collect()}
        want = {x.g: x.v for x in df.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("v")).collect() if x.v is not None}
        assert got == pytest.approx(want)
