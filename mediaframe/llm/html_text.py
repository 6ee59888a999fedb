"""Visible text of HTML pages, laid out as a browser would show it."""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm.sqltext import with_key

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object video audio canvas datalist meta link base param source track area".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option section select summary caption thead tbody tfoot tr".split())
#: What an opening tag ends, up to the nearest of the tags named after it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Elements that only change how text looks: their ends do not end the blocks inside them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SCOPES = frozenset("table td th caption button object html template".split())
ACROSS = SCOPES | frozenset("tr tbody thead tfoot".split())  # whose end tags look past open scopes
_BLANK = r"[ \t\n\r\f]"
_TEXT = re.compile(r"(?:[^<]++|<(?![a-zA-Z/!?])|</\Z)++")
_TAG = re.compile(r"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)(>?)")
_GAP = re.compile(r"[ \t\n\r\f/]*+")
_NAME = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+")
_EQUALS = re.compile(rf"{_BLANK}*+={_BLANK}*+")
_BARE = re.compile(r"[^ \t\n\r\f>]++")
_SPACE = re.compile(rf"{_BLANK}+")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_CSS_PART = re.compile(r"([^{}]*+)([{}])")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
ROUNDS = 8  # blocks at most that move out of one formatting element, as in browsers
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
DEEPEST, PADDING, NESTED = 256, 1 << 20, 64  # columns of indent, characters of padding in a table, and aligned tables inside each other, that a page may ask for at most


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(html: str, at: int) -> tuple[dict[str, str], int] | None:
    """Attributes from `at` on and the place after the tag's end; None if the page ends first.

    A quote opens a value only right after an equals sign; elsewhere it is part of a name or of a
    value without quotes, as in a browser.
    """
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return found, at + 1
        name = _NAME.match(html, at)
        at, value = name.end(), ""
        equals = _EQUALS.match(html, at)
        if equals:
            at = equals.end()
            quote = html[at : at + 1]
            if quote in ('"', "'"):
                stop = html.find(quote, at + 1)
                if stop < 0:
                    return None
                value, at = html[at + 1 : stop], stop + 1
            elif quote and quote != ">":
                bare = _BARE.match(html, at)
                value, at = bare.group(), bare.end()
        found.setdefault(name.group().lower(), value)


def parse(html: str) -> tuple[Node, list[str]]:
    """A tree of elements and strings, with implied ends and the implied tbody and tr; and the style sheets in it.

    The end of a formatting element leaves the blocks open that stand in it: they move out of it, one out of the
    other, and what each holds so far goes into a copy of it. Other inline elements' ends are passed
    over where a block is open inside. Where the open elements of each tag stand is kept beside the stack, so that no step looks
    through elements that it does not close: time is linear in the page however deep it nests.
    """
    root, sheets = Node("html"), []
    stack, where, scopes, blocks = [root], {"html": [0]}, [0], [0]
    holder: list[list] = [[root]]  # the children among which each open element is the last
    gone: dict[int, int] = {}  # places of elements that ended before what stands above them, and a place below each
    at, n = 0, len(html)

    def last(tag: str) -> int:
        places = where.get(tag, [])
        while places and places[-1] in gone:
            places.pop()
        return places[-1] if places else -1

    def open_below(place: int) -> int:
        """The nearest place under `place` whose element is still open."""
        passed, place = [], place - 1
        while place in gone:
            passed.append(place)
            place = gone[place]
        for x in passed:
            gone[x] = place
        return place

    def cut(to: int) -> None:
        while len(stack) > to or len(stack) - 1 in gone:
            tag, place = stack.pop().tag, len(stack)
            holder.pop()
            gone.pop(place, None)
            for places in (where[tag], scopes, blocks):
                if places and places[-1] == place:
                    places.pop()

    def close(names, until) -> None:
        """End the innermost open element of `names` inside the nearest of `until`, with those of `names` right around it."""
        found = max(map(last, names))
        if found > max(map(last, until)) and found > 0:
            while (below := open_below(found)) > 0 and stack[below].tag in names:
                found = below
            cut(found)

    def push(tag: str, attrs=None) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        where.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        holder.append(stack[-1].children)
        stack.append(node)
        return node

    def end_formatting(found: int) -> None:
        """Ends the formatting element at `found`, in which blocks are open."""
        ended, above, under = stack[found], open_below(found), found
        gone[found] = above
        first = bisect_right(blocks, found)
        for k in range(first, min(first + ROUNDS, len(blocks))):
            block = blocks[k]
            moved, i = holder[block].pop(), open_below(block)
            holder[block] = stack[above].children
            while i > under:
                if stack[i].tag in FORMATTING:
                    around = Node(stack[i].tag, stack[i].attrs)
                    if moved is stack[block]:
                        holder[block] = around.children
                    around.children.append(moved)
                    moved = around
                gone[i] = above
                i = open_below(i)
            stack[above].children.append(moved)
            copy = Node(ended.tag, ended.attrs)
            copy.children, stack[block].children = stack[block].children, [copy]
            above = under = block

    while at < n:
        m = _TEXT.match(html, at)
        if m:
            stack[-1].children.append(m.group())
            at = m.end()
            continue
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                at = html.index(">", at) + 1
            else:
                ends = [e for e in (html.find("-->", at + 4), html.find("--!>", at + 4)) if e >= 0]
                at = html.index(">", min(ends)) + 1 if ends else n
            continue
        m = _TAG.match(html, at)
        if m is None:  # <! <? </ and no letter: a comment to the next >
            stop = html.find(">", at)
            at = stop + 1 if stop >= 0 else n
            continue
        end, name, closed = m.groups()
        attrs, at = ({}, m.end()) if closed else attributes(html, m.end()) or ({}, -1)
        if at < 0:  # the page ends inside a tag
            break
        tag = name.lower()
        if end:
            if tag == "p" and last("p") < scopes[-1]:
                stack[-1].children.append(Node("p"))
            found = last(tag)
            if found > (0 if tag in ACROSS else scopes[-1]):
                if tag in BLOCKS or tag in SCOPES or blocks[-1] < found:
                    cut(found)
                elif tag in FORMATTING:
                    end_formatting(found)
            continue
        if tag == "html":
            continue
        if tag in BLOCKS and tag not in ("option", "optgroup") and last("p") > scopes[-1]:
            cut(last("p"))
        if tag in ENDS:
            close(*ENDS[tag])
        if tag == "tr" and stack[-1].tag == "table":
            push("tbody")
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if stack[-1].tag == "table":
                push("tbody")
            push("tr")
        if tag in VOID:
            stack[-1].children.append(Node(tag, attrs))
        elif tag in RAW:
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            stop = _raw_end(tag).search(html, at)
            body = html[at : stop.start() if stop else n]
            node.children.append(body if tag in ("title", "textarea") else escape(body))
            at = html.find(">", stop.start()) + 1 or n if stop else n
            if tag == "style" and not re.search(r"\b(?:print|speech)\b", attrs.get("media", "")):
                sheets.append(body)
        else:
            push(tag, attrs)
    return root, sheets


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I)


class Looks:
    """What a page's own style sheets and its elements say about `display` and `visibility`.

    Selectors of one tag, classes and an id are obeyed, outside print and speech media; those that
    look at an element's surroundings or attributes, and linked sheets, are not.
    """

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = {}
        self.count = 0  # later rules win among equals
        for sheet in sheets:
            open_: list[tuple[bool, str | None]] = [(True, None)]
            for before, brace in _CSS_PART.findall(_CSS_COMMENT.sub(" ", sheet)):
                head = before.rpartition(";")[2].strip()
                if brace == "{":
                    media = not head.startswith("@") or head[:6].lower() == "@media" and not re.search(r"\b(?:print|speech)\b", head) or head.startswith(("@supports", "@layer"))
                    open_.append((open_[-1][0] and media, None if head.startswith("@") else head))
                elif len(open_) > 1:
                    holds, selector = open_.pop()
                    if holds and selector:
                        self.add(selector, self.declared(before))

    @staticmethod
    def declared(text: str) -> list[tuple[str, str, bool]]:
        return [(p.lower(), v.lower(), bool(i)) for p, v, i in _DECLARED.findall(text)]

    def add(self, selectors: str, declared: list[tuple[str, str, bool]]) -> None:
        for one in selectors.split(",") if declared else ():
            m = _SELECTOR.fullmatch(one.strip())
            if m and m.group():
                tag = (m[1] or "*").lower()
                names = re.findall(r"[.#][\w-]+", m[2])
                ids, classes = [x for x in names if x[0] == "#"], [x for x in names if x[0] == "."]
                weight, self.count = (len(ids), len(classes), tag != "*", self.count), self.count + 1
                self.rules.setdefault((ids + classes + [tag])[0], []).append((tag, set(names), weight, declared))

    def of(self, node: Node) -> tuple[bool, str | None]:
        """Whether the element is displayed, and its own visibility if it has any."""
        a, best = node.attrs, {}
        if "hidden" in a or node.tag == "dialog" and "open" not in a:
            best["display"] = ((False,), "none")
        if self.rules:
            names = {f".{c}" for c in unescape(a.get("class", "")).split()} | ({f"#{unescape(a['id'])}"} if "id" in a else set())
            for key in (*names, node.tag, "*"):
                for tag, needs, weight, declared in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and needs <= names:
                        for p, v, important in declared:
                            best[p] = max(best.get(p, ((False,), "")), ((important, 0, weight), v))
        if "style" in a:
            for i, (p, v, important) in enumerate(self.declared(unescape(a["style"]))):
                best[p] = max(best.get(p, ((False,), "")), ((important, 1, (i,)), v))
        return best.get("display", ("", ""))[1] != "none", best["visibility"][1] if "visibility" in best else None


class Page:
    """Text being laid out: lines, the blank line or break still owed, and the indent of lists."""

    def __init__(self):
        self.lines, self.line, self.owed, self.indents, self.mark, self.space = [], [], 0, [""], "", False

    def feed(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def gap(self, blank: bool) -> None:
        self.feed()
        self.owed = max(self.owed, 2 if blank else 1)

    def indent(self, width: int) -> None:
        self.indents.append((self.indents[-1] + " " * width)[: max(DEEPEST, len(self.indents[-1]))])

    def begin(self) -> None:
        if not self.line:
            if self.owed == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.owed = 0
            self.line.append(self.indents[-2 if self.mark else -1] + self.mark)
            self.mark = ""

    def write(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text == " ":
            self.space = bool(self.line)
            return
        if not text:
            return
        head = text[0] == " "
        if (head or self.space) and self.line and self.line[-1][-1:] not in ("", " "):
            text = " " + text.lstrip(" ")
        elif head:
            text = text[1:]
        self.begin()
        self.space = text[-1] == " "
        self.line.append(text.rstrip(" "))

    def exact(self, text: str) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                self.begin()
                self.feed()
            if part:
                self.begin()
                self.line.append(part)

    def text(self) -> str:
        self.feed()
        return "\n".join(self.lines).strip("\n")


def _whole(node: Node, name: str, default: int) -> int:
    value = node.attrs.get(name, "")
    return int(value) if re.fullmatch(r"-?\d{1,9}", value) else default


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "")
    return min(max(int(value), 1), 1000) if value.isdecimal() else 1


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, column span, row span) as lines with their columns aligned.

    Columns are as wide as their widest cell. Only where that would take more than `PADDING`
    characters of padding are the widest columns not waited for to their full width.
    """
    placed, held, width, lines = [], [], {}, 0  # held: (first column, end, rows left), in order
    for cells in rows:
        line, column, later, at, tall = [], 0, [(a, b, k - 1) for a, b, k in held if k > 1], 0, 0
        for text, across, down in cells:
            while at < len(held) and held[at][0] <= column:
                column = max(column, held[at][1])
                at += 1
            parts = text.split("\n")
            tall = max(tall, len(parts))
            line.append((column, parts))
            if across == 1:
                width[column] = max(width.get(column, 0), max(map(len, parts)))
            if down > 1:
                later.append((column, column + across, down - 1))
            column += across
        placed.append(line)
        held, lines = sorted(later), lines + tall
    widest, order = max(width.values(), default=0), sorted(width.values())
    total, inside = sum(order), sum(len(x) for line in placed for _, parts in line for x in parts)
    if lines * total - inside > PADDING:  # the largest limit of a column's width that keeps the padding in bounds
        low, high = 0, widest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if lines * sum(min(w, middle) for w in order) <= PADDING else (low, middle - 1)
        width = {c: min(w, low) for c, w in width.items()}
    start, at = {}, 0
    for c in sorted(width):
        start[c] = at
        at += width[c] + 2
    columns = sorted(start)
    out = []
    for line in placed:
        for i in range(max((len(p) for _, p in line), default=0)):
            s, size = [], 0
            for c, parts in line:
                if i < len(parts) and parts[i]:
                    after = bisect_left(columns, c)
                    to = start[columns[after]] if after < len(columns) else at
                    gap = to - size if size < to else 2 * (size > 0)
                    s += [" " * gap, parts[i]]
                    size += gap + len(parts[i])
            out.append("".join(s).rstrip())
    return out


def render(root: Node, looks: Looks) -> str:
    """The tree's visible text. Paragraph-like blocks stand apart by a blank line, other blocks on
    lines of their own; list items carry marks and indents; table cells are aligned."""
    page = Page()
    pages, tables, lists, pre, seen = [page], [], [], 0, [True]
    work: list = [(root, True)]
    while work:
        node, enter = work.pop()
        if isinstance(node, str):
            if not seen[-1]:
                continue
            text = unescape(node)
            if pre:
                page.exact(text)
            else:
                page.write(text)
            continue
        tag = node.tag
        if enter:
            if tag in HIDDEN:
                continue
            displayed, visibility = looks.of(node) if node.attrs or looks.rules else (tag != "dialog", None)
            if not displayed:
                continue
            if tag == "br":
                if seen[-1]:
                    page.begin()
                    page.feed()
                continue
            if tag in VOID and tag != "hr":
                continue
            if tag in BLOCKS:
                page.gap(tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                back = tag == "ol" and "reversed" in node.attrs
                start = _whole(node, "start", sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1)
                lists.append([tag == "ol", start, -1 if back else 1])
            elif tag == "li":
                ordered, number, step = lists[-1] if lists else (False, 0, 1)
                number = _whole(node, "value", number)
                mark = f"{number}. " if ordered else "- "
                if lists:
                    lists[-1][1] = number + step
                page.indent(len(mark))
                page.mark = mark
            elif tag == "dd":
                page.indent(4)
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([] if len(tables) < NESTED else None)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1] is None:
                page.gap(False)
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                page = Page()
                pages.append(page)
            seen.append(seen[-1] if visibility in (None, "inherit") else visibility == "visible")
            if tag == "li" and not seen[-1]:
                page.mark = ""
            work.append((node, False))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            work += [(c, True) for c in reversed(children)]
            continue
        seen.pop()
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("li", "dd"):
            page.feed()
            page.indents.pop()
            page.mark = ""
        elif tag == "pre":
            pre -= 1
        elif tag in ("td", "th") and tables and tables[-1] is None:
            page.gap(False)
        elif tag in ("td", "th") and tables:
            pages.pop()
            text, page = page.text(), pages[-1]
            tables[-1][-1].append((text, _span(node, "colspan"), _span(node, "rowspan")))
        elif tag == "table":
            for line in table_lines(tables.pop() or []):
                page.begin()
                page.line.append(line)
                page.feed()
        if tag in BLOCKS:
            page.gap(tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists))
    return page.text()


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    root, sheets = parse(html)
    return render(root, Looks(sheets))


def extract_text(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keys` and text; one row per input row, repeated rows each, ties none; other columns are not read.

    Null and empty pages give '', an empty table an empty result. Each page is parsed on its own in
    time linear in its length, so a task holds one Arrow batch and the tree of one page, however
    long; nothing is shuffled. No text is left out for its length, depth or width: indents stop
    growing at `DEEPEST` columns, cells of tables inside `NESTED` others stand as blocks, and a table whose alignment would need more than `PADDING`
    characters of padding has narrower columns.
    """
    own = pages.select(F.struct(*keys).alias("key"), F.col(html).alias("html"))

    def texts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(h.as_py()) for h in b.column(1)], pa.string())], names=["key", "text"])

    return own.mapInArrow(texts, with_key(own.schema["key"].dataType, "text string")).select("key.*", "text")
