"""Visible text of HTML pages, laid out as a text browser would.

A tolerant tree builder (implied end tags, void and raw-text elements, unmatched tags ignored, any depth)
feeds a renderer. Hidden are: head matter, script, style, template, noscript and the like, elements with the hidden
attribute or display:none, closed dialogs, hidden inputs; visibility:hidden is handed down until visibility:visible. Both
properties are taken from style attributes and from the page's style sheets, there by rules whose selectors are an element,
classes, an id or these joined (at-rules and longer selectors are left out), the more specific and later rule first.
Blocks start lines, paragraphs and other blocks with margins are set apart by one empty line, list items carry their mark
(numbers go by start, reversed and value) and indent, pre keeps its white space, table cells are padded to their column's
width, columns below a rowspan left free, rows of tfoot last. Of a select every option's label is a line, of svg and math the text stays.

Bounds that keep a page's text in proportion to its markup, and no text from it: indents stop at INDENT characters; a table
whose spans would fill over SPREAD places a cell is laid out without spans, and one that padding would make over SPREAD / 4
times its text (and PADDING characters) is parted by two blanks instead.

Defined results: null html is empty; malformed markup is read as far as it goes; text outside any element counts; an
empty table gives an empty result; only page_id and html are read. Each page is one row: no shuffle.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

INDENT, SPREAD, PADDING = 400, 64, 1 << 16
# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
#: Hidden inside svg and math only: descriptions and other notations, which are not drawn.
UNDRAWN = frozenset("desc metadata annotation annotation-xml".split())
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr form".split())
BLOCK = LOOSE | frozenset("html body div section article aside nav header footer main address li dt dd tr caption figcaption legend details summary center option optgroup thead tbody tfoot hgroup search menu dialog".split())
ENDS_P = (BLOCK - frozenset("html body tr caption thead tbody tfoot option optgroup legend".split())) | {"hr"}
#: start tag -> (open elements that it closes, elements that stop the search)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select", "datalist")), "body": (("head",), ()),
}
_HEAD = frozenset("head meta link base title style script noscript template".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GAP = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "look")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.look = declared(attrs["style"]) if "style" in attrs else {}


def declared(style: str) -> dict[str, str]:
    """What declarations say last of display and visibility."""
    out: dict[str, str] = {}
    for part in _COMMENT.sub("", style).split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.partition("!")[0].strip().lower()
        if name in ("display", "visibility") and value:
            out[name] = value
    return out


def _rules(sheets: list[str]) -> dict[str, list[tuple[tuple[int, int, int], str, frozenset[str], dict[str, str]]]]:
    """By the key an element must have (#id, .class or tag): (ids, classes, order), tag, all marks it must have, declarations."""
    out: dict[str, list] = {}
    text = _COMMENT.sub("", " ".join(sheets))
    at, depth = 0, 0
    plain = []  # without at-rules and what they hold
    for m in re.finditer(r"@[^{};]*[{;]|[{}]", text):
        if depth == 0 and m[0][0] == "@":
            plain.append(text[at : m.start()])
            depth, at = (1, at) if m[0][-1] == "{" else (0, m.end())
        elif depth:
            depth += 1 if m[0][-1] == "{" else -1 if m[0] == "}" else 0
            at = m.end()
    plain.append(text[at:] if not depth else "")
    for n, (selectors, body) in enumerate(_RULE.findall("".join(plain))):
        says = declared(body)
        for sel in selectors.split(",") if says else ():
            m = _SIMPLE.fullmatch(sel.strip())
            if not m or not sel.strip():
                continue
            tag, marks = (m[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2]))
            key = max(marks, default=tag, key=lambda k: k[0] == "#")
            out.setdefault(key, []).append(((sum(k[0] == "#" for k in marks), sum(k[0] == "." for k in marks), n), tag, marks, says))
    return out


def styled(root: Node) -> None:
    """Adds what the page's style sheets say to the elements' own styles."""
    todo, every, sheets = [root], [], []
    while todo:
        node = todo.pop()
        every.append(node)
        todo += [k for k in node.kids if not isinstance(k, str)]
        if node.tag == "style":
            sheets.append("".join(k for k in node.kids if isinstance(k, str)))
    rules = _rules(sheets[::-1]) if sheets else {}  # the stack gives the page's elements last first
    for node in every if rules else ():
        marks = {f".{c}" for c in node.attrs.get("class", "").split()} | ({f"#{node.attrs['id']}"} if node.attrs.get("id") else set())
        fit = [r for k in (*marks, node.tag, "*") for r in rules.get(k, ()) if r[2] <= marks and r[1] in ("*", node.tag)]
        for _, tag, _, says in sorted(fit, key=lambda r: (r[0][0], r[0][1], r[1] != "*", r[0][2])):
            node.look = {**node.look, **{k: v for k, v in says.items() if k not in declared(node.attrs.get("style", ""))}}


def tree(source: str) -> tuple[Node, int]:
    """The root element and the greatest depth."""
    root = Node("html", {})
    stack, depth = [root], 1
    held: Counter[str] = Counter()  # open elements by tag, so that nothing is searched for in vain

    def cut(at: int) -> None:
        held.subtract(n.tag for n in stack[at:])
        del stack[at:]

    def shut(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Close the outermost open element of `tags` above the nearest of `stop`."""
        low = None
        if not any(held[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in tags:
                low = i
        if low is not None:
            cut(low)

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else end]
        if text:
            if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                cut(-1)
            stack[-1].kids.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attr_text = m[2].lower(), m[3] or m[4] or ""  # m[4]: a quote that nothing closes
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif held[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(attr_text)} if attr_text else {}
        if tag in ("html", "body"):
            shut(("head",), ())
            root.attrs |= attrs
            root.look |= declared(attrs.get("style", ""))
            continue
        if stack[-1].tag == "head" and tag not in _HEAD:
            cut(-1)
        if tag in IMPLIED:
            shut(*IMPLIED[tag])
        if tag in ENDS_P:
            shut(("p",), ("table", "td", "th", "li", "div", "section", "article", "blockquote"))
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].kids.append(row)
            stack.append(row)
            held["tr"] += 1
        foreign = (tag in UNDRAWN or tag in RAW) and (held["svg"] or held["math"])
        if foreign and tag in UNDRAWN:
            attrs["hidden"] = ""
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID or attr_text.endswith("/") and tag not in BLOCK and (foreign or tag not in RAW):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            body = source[at : close.start()]
            node.kids.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = close.end()
            continue
        stack.append(node)
        held[tag] += 1
        depth = max(depth, len(stack))
    return root, depth


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or "hidden" in a or node.look.get("display") == "none" or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden")


def unseen(node: Node, parent: bool) -> bool:
    """Whether the element's own text is invisible: what its style says last, else as its parent's."""
    said = node.look.get("visibility", "inherit")
    return said in ("hidden", "collapse") if said in ("hidden", "collapse", "visible", "initial") else parent


class Page:
    """Lines of text being filled: collapses white space and blank lines as the layout asks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.space, self.gap, self.indent, self.mark = "", False, False, "", ""
        self.unseen = False

    def deeper(self, by: str) -> str:
        return self.indent + by if len(self.indent) < INDENT else self.indent

    def text(self, s: str, keep: bool) -> None:
        if self.unseen:
            return
        if keep:
            parts = s.split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.newline(True)
                self._put(part)
            return
        parts = _GAP.split(s)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                self._put((" " if self.space and self.now else "") + part)
                self.space = False

    def _put(self, s: str) -> None:
        if s and not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead, self.mark = (self.mark or self.indent), ""
            self.lines.append(lead)
            self.now = "x"
        if s:
            self.lines[-1] += s

    def newline(self, even_empty: bool = False) -> None:
        if self.now:
            self.now = ""
        elif even_empty and self.lines and not self.gap:
            self.lines.append("")
        self.space = False

    def apart(self) -> None:
        self.newline()
        self.gap = True


def _number(said: str | None, otherwise: int) -> int:
    return int(said) if said and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", said) else otherwise


Cell = tuple[str, int, int]  # text, columns, rows


def _span(cell: Node, name: str, most: int) -> int:
    said = cell.attrs.get(name, "1")
    n = int(said) if said.isascii() and said.isdigit() and len(said) < 9 else 1
    return min(n, most) if n else (most if name == "rowspan" else 1)  # rowspan=0: all rows of the group that follow


def _group(node: Node, unseen_: bool, captions: list[str], groups: list[list[list[Cell]]], last: list[list[list[Cell]]]) -> None:
    """Rows of a table or a row group, in the order of the page; those of tfoot go to `last`."""
    rows: list[list[Cell]] = []
    groups.append(rows)
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip() and not unseen_:
                captions.append(_GAP.sub(" ", kid).strip())
        elif hidden(kid):
            continue
        elif kid.tag == "tr":
            dim = unseen(kid, unseen_)
            row: list[Cell] = []
            for c in kid.kids:
                if isinstance(c, str):
                    if c.strip() and not dim:
                        row.append((_GAP.sub(" ", c).strip(), 1, 1))
                elif not hidden(c):
                    row.append((render(c, dim), _span(c, "colspan", 1000), _span(c, "rowspan", 65534)))
            rows.append(row)
        elif kid.tag in ("thead", "tbody", "tfoot"):
            _group(kid, unseen(kid, unseen_), captions, last if kid.tag == "tfoot" else groups, last)
            rows = []  # later rows of the table itself are a group of their own
            groups.append(rows)
        else:
            captions.append(render(kid, unseen_))


def _placed(rows: list[list[Cell]]) -> list[list[tuple[int, str, int]]]:
    """Column, text and columns of each cell; columns that a cell above still fills are passed over."""
    out, filled = [], {}
    for row in rows:
        at, cells, below = 0, [], {}
        for text, span, down in row:
            while at in filled:
                at += 1
            cells.append((at, text, span))
            if down > 1:
                below |= dict.fromkeys(range(at, at + span), down - 1)
            at += span
        filled = {c: n - 1 for c, n in filled.items() if n > 1} | below
        out.append(cells)
    return out


def _table(node: Node, unseen_: bool) -> str:
    captions: list[str] = []
    groups: list[list[list[Cell]]] = []
    last: list[list[list[Cell]]] = []
    _group(node, unseen_, captions, groups, last)
    cells, places = 0, 0
    for g in groups + last:
        for k, row in enumerate(g):
            cells += len(row)
            places += sum(span * min(down, len(g) - k) for _, span, down in row)
    if places > SPREAD * cells + PADDING:
        groups, last = ([[[(s, 1, 1) for s, _, _ in row] for row in g] for g in part] for part in (groups, last))
    rows = [r for g in groups + last for r in _placed(g)]
    width: dict[int, int] = {}
    for row in rows:
        for at, s, span in row:
            if span == 1:
                width[at] = max(width.get(at, 0), *(len(x) for x in s.split("\n")))
    begin, total = [], 0
    for at in range(max((c[0] for r in rows for c in r), default=-1) + 1):
        begin.append(total)
        total += width.get(at, 0) + 2
    lines = [c for c in captions if c]
    texts = sum(len(s) + 2 for row in rows for _, s, _ in row)
    if sum(begin[row[-1][0]] * (1 + max(s.count("\n") for _, s, _ in row)) for row in rows if row) > SPREAD // 4 * texts + PADDING:
        begin = [0] * len(begin)
    for row in rows:
        parts = [(at, s.split("\n")) for at, s, _ in row]
        for i in range(max((len(x) for _, x in parts), default=0)):
            out = ""
            for at, part in parts:
                if at:
                    out = out.ljust(begin[at]) if len(out) + 2 <= begin[at] else out + "  "
                out += part[i] if i < len(part) else ""
            if out.strip():
                lines.append(out.rstrip())
    return "\n".join(lines)


def _walk(node: Node, page: Page, keep: bool, bullet: list) -> None:
    dim = page.unseen
    page.unseen = unseen(node, dim)
    _kids(node, page, keep, bullet)
    page.unseen = dim


def _kids(node: Node, page: Page, keep: bool, bullet: list) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            page.text(kid, keep)
            continue
        if hidden(kid):
            continue
        tag = kid.tag
        if tag == "br":
            page.newline(True)
            continue
        if tag == "img":
            if not unseen(kid, page.unseen):
                page.text(kid.attrs.get("alt", ""), False)
            continue
        if tag == "input":
            page.text(kid.attrs.get("value", "") if not unseen(kid, page.unseen) and kid.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") else "", False)
            continue
        loose, block = tag in LOOSE and not (tag in ("ul", "ol", "menu") and bullet), tag in BLOCK
        if loose:
            page.apart()
        elif block:
            page.newline()
        if tag == "hr":
            page.text("----", True)
        elif tag == "table":
            dim, page.unseen = page.unseen, False  # the table leaves out what is invisible
            page.text(_table(kid, unseen(kid, dim)), True)
            page.unseen = dim
        elif tag in ("ul", "ol", "menu"):
            back = tag == "ol" and "reversed" in kid.attrs
            first = sum(not isinstance(k, str) and k.tag == "li" and not hidden(k) for k in kid.kids) if back else 1
            _walk(kid, page, keep, [[tag == "ol", _number(kid.attrs.get("start"), first), -1 if back else 1]])
        elif tag == "li":
            old = page.indent
            mark = "- "
            if bullet and bullet[-1][0]:
                now = _number(kid.attrs.get("value"), bullet[-1][1])
                mark = f"{now}. "
                bullet[-1][1] = now + bullet[-1][2]
            page.mark, page.indent = old + mark, page.deeper(" " * len(mark))
            _walk(kid, page, keep, bullet)
            page.indent, page.mark = old, ""
        elif tag in ("blockquote", "dd"):
            old, page.indent = page.indent, page.deeper("  ")
            _walk(kid, page, keep, bullet)
            page.newline()
            page.indent = old
        elif tag == "optgroup":
            page.text(kid.attrs.get("label", ""), False)
            page.newline()
            _walk(kid, page, keep, bullet)
        elif tag == "option" and kid.attrs.get("label"):
            page.text(kid.attrs["label"], False)
        elif tag == "text":  # of svg: drawn in a place of its own
            page.space = True
            _walk(kid, page, keep, bullet)
            page.space = True
        elif tag == "q":
            page.text('"', True)
            _walk(kid, page, keep, bullet)
            page.text('"', True)
        else:
            _walk(kid, page, keep or tag in ("pre", "textarea", "xmp"), bullet)
        if loose:
            page.apart()
        elif block:
            page.newline()


def render(node: Node, unseen_: bool = False) -> str:
    page = Page()
    page.unseen = unseen_
    _walk(node, page, node.tag == "pre", [])
    return "\n".join(x.rstrip() for x in page.lines).strip("\n")


def extract(source: str | None) -> str:
    if not source:
        return ""
    root, depth = tree(source)
    styled(root)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 6 * depth + 1000))  # at most five calls a level
    try:
        return "" if hidden(root) else render(root)
    finally:
        sys.setrecursionlimit(limit)


def apply(pages: DataFrame) -> DataFrame:
    """page_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract(x) for x in part.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html")).mapInArrow(run, "page_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")
