"""Layout-aware HTML rendering to text.

A tree builder that knows implied and optional tags turns a page into nodes;
nodes that aren't displayed are left out; the rest is laid out: blocks on lines
of their own, blank lines around paragraphs, list markers and indents, table
cells in aligned columns with the lines they have, preformatted text as it stands.

Visibility follows CSS as far as one element's own rules go: ``display: none`` and
``hidden`` remove an element with all it holds; ``visibility`` is inherited, and a
visible child of a hidden parent is shown.  Rules come from ``style`` attributes
and from the page's style elements, there from selectors of one element (tag,
class, id, any of them joined); selectors with combinators, attributes or
pseudo-classes and rules within at-rules are passed over.

The text is of the order of its page.  Indents end at ``DEEPEST`` columns.  A table
is aligned with the widest limit of ``WIDTHS`` at which the padding of the page's
tables stays within ``PADDING`` times the page; cells wider than the limit stand
unpadded, and at the last limit, none, cells are parted by two spaces.

Null and empty pages give an empty text; unclosed and stray tags are repaired;
trees of any depth are walked without recursion; long pages are rendered whole;
repeated rows give equal rows; an empty table gives an empty result; extra
columns are dropped unless kept.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from fluxmill.llm.common import slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object video audio canvas datalist area param source track defs desc metadata symbol clippath annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset xmp menu".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li main nav optgroup option search section summary tbody td tfoot th thead tr caption".split())
CLOSES_P = PARAGRAPHS | frozenset("address article aside center details dialog dir div dd dt figcaption footer form header hgroup hr li main nav search section summary".split())
#: A start tag of the first kind ends open elements of the second, up to one of the third.
IMPLIED = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: End tags that reach through other open elements stop at these.
FENCES = frozenset("table td th caption html template button".split())
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GAPS = re.compile(r"[ \t\r\n\f]+")
_DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)*\Z")

# Limits of the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Columns that indents may take; cell widths up to which columns are aligned, tried in order; padding allowed in all, as a multiple of the page.
DEEPEST = 40
WIDTHS = (60, 30, 15, 0)
PADDING = 4


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict[str, str] | None:
    if not text or text.isspace() or text == "/":
        return None
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Stack(list):
    """Open elements, with how many there are of each name."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.held = Counter([root.tag])

    def push(self, node: Node) -> None:
        self.append(node)
        self.held[node.tag] += 1

    def cut(self, at: int) -> None:
        """Close the element at that place and all within it."""
        for node in self[at:]:
            self.held[node.tag] -= 1
        del self[at:]


def parse(page: str) -> Node:
    """The page's tree, with implied elements opened and closed."""
    root = Node("html")
    stack = Stack(root)
    low = None
    at, n = 0, len(page)
    in_head = True
    while at < n:
        found = _TOKEN.search(page, at)
        end = found.start() if found else n
        if end > at:
            text = page[at:end]
            if in_head and not text.isspace() and stack[-1].tag in ("html", "head"):
                in_head = False
                stack.cut(1)
            stack[-1].kids.append(unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            _end(stack, tag)
            continue
        if tag == "html":
            continue
        if in_head and tag not in IN_HEAD:
            in_head = False
            while len(stack) > 1 and stack[-1].tag == "head":
                stack.cut(len(stack) - 1)
        if tag in CLOSES_P:
            _close(stack, "p")
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.cut(len(stack) - 1)
        rule = IMPLIED.get(tag)
        if rule and any(stack.held[x] > 0 for x in rule[0]):
            ends, until = rule
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in ends:
                    lowest = k
                    while lowest > 1 and stack[lowest - 1].tag in ends:
                        lowest -= 1
                    stack.cut(lowest)
                    break
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            _open(stack, Node("tr"))
        node = Node(tag, _attributes(found[3]))
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
            stop = low.find("</" + tag, at) if len(low) == n else page.find("</" + tag, at)
            body = page[at : stop if stop >= 0 else n]
            node.kids.append(unescape(body) if tag in ("textarea", "title") else body)
            close = page.find(">", stop) if stop >= 0 else -1
            at = close + 1 if close >= 0 else n
            continue
        stack.push(node)
    return root


def _open(stack: Stack, node: Node) -> None:
    stack[-1].kids.append(node)
    stack.push(node)


def _close(stack: Stack, tag: str) -> None:
    """Close an open element of that name unless a fence stands before it."""
    if stack.held[tag] <= 0:
        return
    for k in range(len(stack) - 1, 0, -1):
        here = stack[k].tag
        if here == tag:
            stack.cut(k)
            return
        if here in FENCES:
            return


def _end(stack: Stack, tag: str) -> None:
    if tag == "br":
        stack[-1].kids.append(Node("br"))
    elif not any(stack.held[x] > 0 for x in (HEADINGS if tag in HEADINGS else (tag,))):
        return
    elif tag in HEADINGS:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in HEADINGS:
                stack.cut(k)
                return
            if stack[k].tag in FENCES:
                return
    elif tag in ("table", "tr", "tbody", "thead", "tfoot", "body"):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if tag != "body":  # what follows the body still belongs to it
                    stack.cut(k)
                return
            if stack[k].tag == "table" and tag != "table":
                return
    elif tag in FENCES:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                stack.cut(k)
                return
            if stack[k].tag == "table":
                return
    elif tag != "html":
        _close(stack, tag)


def declared(text: str) -> list[tuple[str, str, bool]]:
    """(display or visibility, value, important) of a block of declarations, in order."""
    return [(n.lower(), v.lower(), bool(i)) for n, v, i in _DECLARED.findall(text)]


class Styles:
    """What the page's style elements say about display and visibility, by selectors of one element."""

    def __init__(self, sheets: Iterable[str]):
        self.rules: dict[tuple[str, str], list] = {}  # by one thing the element must have: ("#", id), (".", class) or ("", tag)
        number = 0
        for sheet in sheets:
            at = 0
            sheet = _COMMENT.sub(" ", sheet)
            while (begin := sheet.find("{", at)) >= 0:
                head, end = sheet[at:begin].rpartition(";")[2].strip(), sheet.find("}", begin)
                end = len(sheet) if end < 0 else end
                if head.startswith("@"):  # passed over with all the blocks it holds
                    depth, at = 1, begin + 1
                    while depth and at < len(sheet):
                        depth += (sheet[at] == "{") - (sheet[at] == "}")
                        at += 1
                    continue
                at = end + 1
                says = declared(sheet[begin + 1 : end])
                for selector in head.split(",") if says else ():
                    selector = selector.strip()
                    if not selector or not _SIMPLE.match(selector):
                        continue
                    number += 1
                    tag, *more = re.split(r"(?=[.#])", selector)
                    tag = "" if tag == "*" else tag.lower()
                    needs = frozenset((m[0], m[1:]) for m in more) | ({("", tag)} if tag else set())
                    weight = (sum(m[0] == "#" for m in more), sum(m[0] == "." for m in more), bool(tag), number)
                    key = max(needs, default=("", "*"), key=lambda x: " .#".find(x[0]) if x[0] else 0)
                    self.rules.setdefault(key, []).append((needs, weight, says))

    def of(self, node: Node) -> dict[str, str]:
        """Display and visibility that rules and the style attribute give the element itself."""
        a = node.attrs or {}
        found = [(False, (1, 0, 0, 0, 0), n, v) if not i else (True, (1, 0, 0, 0, 0), n, v) for n, v, i in declared(a["style"])] if "style" in a else []
        if self.rules:
            has = {("", node.tag), ("", "*"), *((".", c) for c in a.get("class", "").split()), *([("#", a["id"])] if "id" in a else [])}
            for h in has:
                for needs, weight, says in self.rules.get(h, ()):
                    if needs <= has:
                        found += [(i, (0, *weight), n, v) for n, v, i in says]
        if not found:
            return {}
        return {n: v for _, _, n, v in sorted(found, key=lambda f: f[:2])}


def displayed(node: Node, style: dict[str, str]) -> bool:
    """Does the element make a box at all?"""
    if node.tag in UNSEEN or node.tag == "input" or style.get("display") == "none":
        return False
    a = node.attrs or {}
    return "display" in style or not ("hidden" in a or node.tag == "dialog" and "open" not in a)


def _sheets(root: Node) -> list[str]:
    """The texts of the page's style elements."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            out.append("".join(k for k in node.kids if isinstance(k, str)))
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def width(s: str) -> int:
    """Columns of a text on a grid: wide characters take two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines under construction, with pending gaps and an indent."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indents: list[str] = [""]
        self.marker = ""
        self.space = True  # nothing or a space is the last thing on the line

    def deeper(self, by: str) -> None:
        held = self.indents[-1]
        self.indents.append(held + by if len(held) + len(by) <= DEEPEST else held)

    def back(self) -> None:
        if len(self.indents) > 1:
            self.indents.pop()

    def text(self, s: str) -> None:
        s = _GAPS.sub(" ", s)
        if self.space and s[:1] == " ":
            s = s[1:]
        if s:
            self.now.append(s)
            self.space = s[-1] == " "

    def literal(self, s: str) -> None:
        """Preformatted text: line ends are kept."""
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if first:
            self.now.append(first)
        for line in rest:
            self.flush(True)
            if line:
                self.now.append(line)
        self.space = not self.now

    def flush(self, empty: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now, self.space = [], True
        if line or empty:
            if self.gap == 2 and self.lines and (line or self.lines[-1]):
                self.lines.append("")
            self.gap = 0
            head = self.indents[-1]
            if self.marker:  # it stands in the indent's last columns, if the indent has them
                head = (self.indents[-2] if len(self.indents) > 1 else "") + self.marker
                self.marker = ""
            self.lines.append((head + line).rstrip(" "))

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def put(self, lines: Sequence[str]) -> None:
        self.block(1)
        for line in lines:
            self.now.append(line)
            self.flush(True)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    value = (node.attrs or {}).get(name, "").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    number = int(value[:9])
    return min(number, most) if number else most if name == "rowspan" else 1  # a rowspan of 0 reaches to the end


class Grid:
    """A table's cells by row and column, with spans, laid out in aligned columns. Only cells with text are held."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.column = 0  # where the row's next cell may stand
        self.down: list[list[int]] = []  # columns that cells above still fill, in order: first, behind the last, last row

    def row(self) -> None:
        self.rows.append([])
        self.column, now = 0, len(self.rows) - 1
        held: list[list[int]] = []
        for span in sorted(s for s in self.down if s[2] >= now):
            if held and held[-1][1] == span[0] and held[-1][2] == span[2]:
                held[-1][1] = span[1]
            else:
                held.append(span)
        self.down = held

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        now = len(self.rows) - 1
        k = max(0, bisect_right(self.down, [self.column, MOST_COLUMNS * MOST_ROWS, 0]) - 1)
        while k < len(self.down) and self.down[k][0] <= self.column:
            self.column = max(self.column, self.down[k][1])
            k += 1
        if any(lines):
            self.rows[-1].append((self.column, lines))
        self.column += across
        if down > 1:
            self.down.insert(bisect_right(self.down, [self.column - across]), [self.column - across, self.column, now + down - 1])

    def lines(self, room: int) -> tuple[list[str], int]:
        """The table's lines, and how much of ``room``, in characters, their padding may have taken."""
        rows = [r for r in self.rows if r]
        made: list[str] = []
        padding = 0
        for limit in WIDTHS:
            widths: dict[int, int] = {}
            for r in rows:
                for k, c in r:
                    wide = max(map(width, c))
                    widths[k] = max(widths.get(k, 0), wide if wide <= limit else 0)
            order = sorted(widths)
            begin, starts = 0, {}
            for k in order:
                starts[k] = begin
                begin += widths[k] + 2 if widths[k] else 0
            padding = sum(starts[r[-1][0]] * max(len(c) for _, c in r) for r in rows) if limit else 0
            if padding > room:
                continue
            for r in rows:
                for n in range(max(len(c) for _, c in r)):
                    line, at = "", 0
                    for k, c in r:
                        if n < len(c) and c[n]:
                            gap = starts[k] - at if limit and starts[k] - at >= 2 else (2 if line else starts[k] if limit else 0)
                            line += " " * gap + c[n]
                            at += gap + width(c[n])
                    if line:
                        made.append(line.rstrip())
            break
        return made, padding


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", text) else None


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    flow = Flow()
    flows: list[Flow] = []  # of the tables around the current cell
    grids: list[Grid] = []
    lists: list[list] = []  # open lists: tag, next number, step
    pre = 0
    room = PADDING * len(page) + 200
    root = parse(page)
    styles = Styles(_sheets(root))
    todo: list = [(root, False, True)]
    while todo:
        node, leaving, shown = todo.pop()
        if isinstance(node, str):
            if not shown:
                continue
            if pre:
                flow.literal(node)
            elif not flow.space or not node.isspace():
                flow.text(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th"):
                cell = flow.done()
                flow = flows.pop()
                grids[-1].cell(cell, _span(node, "colspan", MOST_COLUMNS), _span(node, "rowspan", MOST_ROWS))
            elif tag == "table":
                outer = flows.pop()
                caption = flow.done()
                flow = outer
                made, padding = grids.pop().lines(room)
                room -= padding
                flow.put([*caption, *made])
                flow.block(2)
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                flow.block(1 if lists else 2)
            elif tag == "li":
                flow.block(1)
                flow.marker = ""
                flow.back()
            elif tag in ("blockquote", "dd"):
                flow.block(1)
                flow.back()
                flow.block(2 if tag == "blockquote" else 1)
            elif tag in ("pre", "xmp"):
                pre -= 1
                flow.block(2)
            elif tag in PARAGRAPHS:
                flow.block(2)
            elif tag in BLOCKS:
                flow.block(1)
            continue
        style = styles.of(node) if node.attrs or styles.rules else {}
        if not displayed(node, style):
            continue
        if "visibility" in style and style["visibility"] != "inherit":
            shown = style["visibility"] not in ("hidden", "collapse")
        if tag == "br":
            flow.flush(True)
            continue
        if tag == "hr":
            flow.block(2)
            continue
        if tag in VOID:
            continue
        attrs, kids = node.attrs or {}, node.kids
        if tag == "details" and "open" not in attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag in ("td", "th") and grids:
            flows.append(flow)
            flow = Flow()
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") and not grids:
            flow.block(1)
            node = Node("div")
        elif tag == "tr":
            grids[-1].row()
        elif tag in ("tbody", "thead", "tfoot", "colgroup"):
            node = Node("span")
        elif tag == "table":
            flow.block(2)
            flows.append(flow)
            flow = Flow()  # takes a caption, and text that stands outside all cells
            grids.append(Grid())
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(1 if lists else 2)
            begin, step = _number(attrs.get("start", "")), 1
            if "reversed" in attrs and tag == "ol":
                begin, step = (sum(isinstance(k, Node) and k.tag == "li" for k in kids) if begin is None else begin), -1
            lists.append([tag, 1 if begin is None else begin, step])
        elif tag == "li":
            flow.block(1)
            marker = "- "
            if lists and lists[-1][0] == "ol":
                value = _number(attrs.get("value", ""))
                if value is not None:
                    lists[-1][1] = value
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += lists[-1][2]
            flow.deeper(" " * len(marker))
            flow.marker = marker if shown else ""
        elif tag in ("blockquote", "dd"):
            flow.block(2 if tag == "blockquote" else 1)
            flow.deeper("  ")
        elif tag in ("pre", "xmp"):
            flow.block(2)
            pre += 1
            if kids and isinstance(kids[0], str):
                kids = [kids[0].removeprefix("\n"), *kids[1:]]
        elif tag in PARAGRAPHS:
            flow.block(2)
        elif tag in BLOCKS:
            flow.block(1)
        todo.append((node, True, shown))
        todo.extend((k, False, shown) for k in reversed(kids))
    return "\n".join(flow.done()).replace("\xa0", " ").strip("\n")


def extract(df: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` plus text, n_chars and text_sha256; narrow, one pass."""
    names = list(keep)
    source = df.select(*names, df[html].alias("__html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(names)):
            texts = [render(h.as_py()) for h in b.column(len(names))]
            digests = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string())], [*names, "text", "n_chars", "text_sha256"])

    return source.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "text string, n_chars bigint, text_sha256 string"]))
