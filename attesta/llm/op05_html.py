"""HTML extraction by layout-aware rendering.

A small tree builder reads the markup with the implied end tags of HTML (a new paragraph ends the
open one, a new cell the open cell, rows that a cell lacks, and so on), drops what is never shown,
and a renderer walks the tree: blocks stand apart, list items get their markers and indentation,
cells of a table are padded to their columns across row and column spans, preformatted text keeps
its white space. Content of a table that is in no cell comes before the table, as browsers show it.

What hides: ``display: none``, ``hidden``, closed dialogs and what closed details hold besides their
summary hide all within; ``visibility`` hides text until it is set to visible further in. Of several
declarations the last of the most specific selector wins, the element's own style over all,
important ones first. Selectors may name tags, classes, ids, and elements inside or directly inside
others; rules with other selectors, and those of at-rules, don't count. Never shown: heads, scripts,
templates, fallbacks of embedded media, options that are not chosen. Pages are rendered where they
lie; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import in_batches
from attesta.llm.textkit import slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe object canvas audio video datalist defs desc metadata symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
ENDS_P = BLOCK - frozenset("body html legend li option optgroup td th tr tbody thead tfoot summary dd dt".split()) | frozenset(["li", "dd", "dt", "table"])
#: A start tag ends the open elements named first, up to the nearest of those named second.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
SECTION = frozenset(["tbody", "thead", "tfoot"])
CELL = frozenset(["td", "th"])
#: Elements that a part of a table stands directly in.
PLACE = {"td": frozenset(["tr"]), "th": frozenset(["tr"]), "tr": SECTION, "tbody": frozenset(), "thead": frozenset(), "tfoot": frozenset(), "caption": frozenset(), "colgroup": frozenset()}
STRUCTURE = frozenset(PLACE) | frozenset(["col"])
SPANS = 1000
#: Elements deeper than this are read as siblings.
DEPTH = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_PART = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")
_MARK = re.compile(r"([.#])([\w-]+)")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility)\s*:\s*([\w-]+)([^;]*)", re.I)
#: Types of input whose value is seen.
FIELDS = frozenset(["", "text", "search", "email", "url", "tel", "number", "date", "time", "month", "week", "datetime-local", "submit", "button", "reset"])
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(markup: str) -> Node:
    root = Node("#root", {})
    open_ = [root]
    at, n = 0, len(markup)
    while at < n:
        m = _TOKEN.match(markup, at)
        at = m.end()
        if m[2] is None:
            text = m[0]
            if text[:2] not in ("<!", "<?"):
                open_[-1].kids.append(html.unescape(text))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                    break  # an end tag in a cell doesn't reach out of it
            continue
        node = Node(tag, _attributes(m[3]) if m[3].strip() else {})
        if tag in ENDS_P:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == "p":
                    del open_[i:]
                    break
                if open_[i].tag in BLOCK:
                    break
        if tag in PLACE and (base := max((i for i in range(len(open_)) if open_[i].tag == "table"), default=0)):
            at_ = next((i for i in range(len(open_) - 1, base, -1) if open_[i].tag in PLACE[tag]), base)
            if tag in CELL and at_ == base:  # a cell without a row makes one
                at_ = next((i for i in range(len(open_) - 1, base, -1) if open_[i].tag in SECTION), base)
                row = Node("tr", {}, open_[at_])
                open_[at_].kids.append(row)
                del open_[at_ + 1 :]
                open_.append(row)
                at_ += 1
            del open_[at_ + 1 :]
        if tag in IMPLIED:
            ended, bound = IMPLIED[tag]
            cut = None
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in bound:
                    break
                if open_[i].tag in ended:
                    cut = i
            if cut is not None:
                del open_[cut:]
        elif open_[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "script", "style", "noscript", "template"):
            open_.pop()  # content begins the body
        node.up = open_[-1]
        open_[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(markup, at)
            inside = markup[at : end.start() if end else n]
            node.kids.append(html.unescape(inside) if tag in ("textarea", "title") else inside)
            at = end.end() if end else n
        elif tag == "form" and open_[-1].tag in ("table", "tr", *SECTION):
            pass  # it stands beside the rows, which don't go into it
        elif tag not in VOID and not m[3].endswith("/") and len(open_) < DEPTH:
            open_.append(node)
    return root


class _Part:
    """A selector without combinators: a tag or any, with classes and ids."""

    def __init__(self, tag: str, marks: list[tuple[str, str]]):
        self.tag, self.classes, self.ids = "" if tag == "*" else tag.lower(), {n for m, n in marks if m == "."}, {n for m, n in marks if m == "#"}

    def fits(self, node: Node) -> bool:
        return (not self.tag or self.tag == node.tag) and (not self.ids or self.ids == {node.attrs.get("id")}) and (not self.classes or self.classes <= set(node.attrs.get("class", "").split()))


def _selector(text: str) -> tuple[tuple[int, int, int], list[tuple[str, _Part]]] | None:
    """Specificity and parts, the last first, each with how it stands to the one behind it; None if there is more to it."""
    parts, how = [], ""
    for x in re.sub(r"\s*>\s*", " > ", text.strip()).split():
        if x == ">":
            if how == ">" or not parts:
                return None
            how = ">"
            continue
        if not (m := _PART.fullmatch(x)):
            return None
        parts.append((how or " ", _Part(m[1] or "", _MARK.findall(m[2]))))
        how = ""
    if not parts or how:
        return None
    weight = tuple(sum(n) for n in zip(*((len(p.ids), len(p.classes), int(bool(p.tag))) for _, p in parts), strict=True))
    return weight, parts[::-1]


def _declared(text: str) -> list[tuple[str, str, bool]]:
    return [(m[1].lower(), m[2].lower(), "!important" in m[3].replace(" ", "").lower()) for m in _DECLARED.finditer(text)]


def _within(parts: list[tuple[str, _Part]], node: Node | None) -> bool:
    """Whether what is around a node fits the rest of a selector, ``parts[0]`` being the node's own."""
    if len(parts) == 1:
        return True
    how, rest = parts[0][0], parts[1:]
    while node is not None:
        if rest[0][1].fits(node) and _within(rest, node.up):
            return True
        if how == ">":
            return False
        node = node.up
    return False


class Sheet:
    """Rules of a page's style sheets about what is shown, by the tag, class or id that an element must have."""

    def __init__(self, root: Node):
        self.rules: dict[str, list] = {}
        order = 0
        todo = [root]
        while todo:
            n = todo.pop()
            if n.tag == "style":
                text = re.sub(r"/\*.*?\*/", "", "".join(k for k in n.kids if isinstance(k, str)), flags=re.S)
                for m in _RULE.finditer(re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^;{}]*;", "", text)):
                    if not (said := _declared(m[2])):
                        continue
                    for one in m[1].split(","):
                        if found := _selector(one):
                            own, order = found[1][0][1], order + 1
                            key = f"#{min(own.ids)}" if own.ids else f".{min(own.classes)}" if own.classes else own.tag
                            self.rules.setdefault(key, []).append((found[0], order, found[1], said))
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def style(self, node: Node) -> dict[str, str]:
        """The winning declarations of the node."""
        own = node.attrs.get("style", "")
        if not self.rules and not own:
            return {}
        best: dict[str, tuple] = {}

        def weigh(said, weight):
            for name, value, important in said:
                if name not in best or (important, *weight) >= best[name][0]:
                    best[name] = (important, *weight), value

        if self.rules:
            for key in {"", node.tag, f"#{node.attrs.get('id')}", *(f".{c}" for c in node.attrs.get("class", "").split())}:
                for specific, order, parts, said in self.rules.get(key, ()):
                    if parts[0][1].fits(node) and _within(parts, node.up):
                        weigh(said, (0, specific, order))
        weigh(_declared(own), (1, (0, 0, 0), 0))
        return {name: value for name, (_, value) in best.items()}


_NONE = Sheet(Node("#none", {}))


def hidden(node: Node, sheet: Sheet = _NONE) -> bool:
    """Whether the node and all in it is not shown."""
    a = node.attrs
    if node.tag in UNSEEN:
        return True
    said = sheet.style(node) if a or sheet.rules else {}
    if said.get("content-visibility") == "hidden":
        return True
    if "display" in said:  # what a page says counts for more than an attribute
        return said["display"] == "none"
    return node.tag == "dialog" and "open" not in a or "hidden" in a and a["hidden"].lower() != "until-found"


def _seen(node: Node, out: _Out) -> bool:
    """Whether text directly in the node is shown."""
    said = out.sheet.style(node).get("visibility") if node.attrs or out.sheet.rules else None
    return out.seen if said not in ("hidden", "collapse", "visible") else said == "visible"


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Out:
    """Lines of text; ``gap`` asks for a number of line ends before the next words."""

    def __init__(self, sheet: Sheet = _NONE, seen: bool = True):
        self.sheet, self.seen = sheet, seen
        self.lines: list[str] = []
        self.now: list[str] = []
        self.wanted = 0
        self.blank = True

    def words(self, text: str, keep: bool) -> None:
        if not self.seen:
            return
        if keep:
            parts = text.replace("\r\n", "\n").split("\n")
            for i, p in enumerate(parts):
                if i:
                    self.line()
                if p:
                    self.put(p)
            return
        for i, w in enumerate(_SPACE.split(text)):
            if i and not self.blank:
                self.now.append(" ")
                self.blank = True
            if w:
                self.put(w)

    def put(self, text: str) -> None:
        if self.wanted and self.lines and self.wanted > 1:
            self.lines.append("")
        self.wanted = 0
        self.now.append(text)
        self.blank = False

    def line(self) -> None:
        if self.wanted and self.lines and self.wanted > 1 and self.now:
            self.lines.append("")
        self.lines.append("".join(self.now).rstrip())
        self.now, self.blank, self.wanted = [], True, 0

    def gap(self, lines: int) -> None:
        if "".join(self.now).strip():
            self.line()
        self.now, self.blank = [], True
        self.wanted = max(self.wanted, lines)

    def done(self) -> list[str]:
        if "".join(self.now).strip():
            self.line()
        return self.lines


def _span(cell: Node, name: str) -> int:
    s = cell.attrs.get(name, "1")
    if name == "rowspan" and s.strip() == "0":
        return SPANS  # to the end of its section
    return max(1, min(SPANS, int(s))) if s.isdigit() and s.isascii() and len(s) < 6 else 1


def _parts(table: Node, sheet: Sheet) -> tuple[list, list[list[Node]], list[Node]]:
    """What stands in no cell, the cells of each row, and what the row stands in, all in order."""
    stray, rows, held = [], [], []
    todo: list[tuple] = [(k, None) for k in reversed(table.kids)]
    while todo:
        k, row = todo.pop()
        if not isinstance(k, Node):
            stray.append(k)
        elif k.tag in STRUCTURE and hidden(k, sheet):
            continue
        elif k.tag in SECTION or k.tag == "tr":
            row = [] if k.tag == "tr" else None
            if row is not None:
                rows.append(row)
                held.append(k.up)
            todo += [(x, row) for x in reversed(k.kids)]
        elif k.tag in CELL and row is not None:
            row.append(k)
        elif k.tag not in ("colgroup", "col"):
            stray.append(k)
    return stray, rows, held


def _table(table: Node, out: _Out, keep: bool) -> None:
    stray, rows, held = _parts(table, out.sheet)
    for k in stray:
        if isinstance(k, Node):
            _render(k, out, keep)
            out.gap(1)
        else:
            out.words(k, keep)
    out.gap(1)
    taken: dict[int, int] = {}  # columns that a cell of an earlier row still fills, and for how many rows
    placed: list[list[tuple[int, int, list[str]]]] = []
    for i, row in enumerate(rows):
        here, at = [], 0
        if i and held[i] is not held[i - 1]:
            taken = {}  # no cell reaches out of its section
        left = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row:
            while at in taken:
                at += 1
            wide, deep = _span(cell, "colspan"), _span(cell, "rowspan")
            here.append((at, wide, render(cell, out.sheet, out.seen).split("\n")))
            if deep > 1:
                left |= dict.fromkeys(range(at, at + wide), deep - 1)
            at += wide
        placed.append(here)
        taken = left
    # Columns in which no cell begins have no width of their own.
    columns = sorted({at for row in placed for at, _, _ in row})
    number = {c: i for i, c in enumerate(columns)}
    widths = [0] * len(columns)
    cells = [[(number[at], bisect.bisect_left(columns, at + wide) - number[at], lines) for at, wide, lines in row] for row in placed]
    for span, first, lines in sorted((span, first, lines) for row in cells for first, span, lines in row):
        more = max(map(_width, lines)) - sum(widths[first : first + span]) - 3 * (span - 1)
        if more > 0:
            widths[first + span - 1] += more
    for row in cells:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line, at = [], 0
            for first, span, lines in row:
                line += [" " * w for w in widths[at:first]]
                text = lines[i] if i < len(lines) else ""
                line.append(text + " " * (sum(widths[first : first + span]) + 3 * (span - 1) - _width(text)))
                at = first + span
            if "".join(line).strip():
                out.put(" | ".join(line).rstrip())
                out.gap(1)


def _list(node: Node, out: _Out, keep: bool) -> None:
    whole = lambda x: int(x) if x is not None and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", x) else None
    back = node.tag == "ol" and "reversed" in node.attrs
    count = whole(node.attrs.get("start"))
    if count is None:
        count = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids) if back else 1
    for k in node.kids:
        if not isinstance(k, Node) or k.tag != "li":
            _render(k, out, keep) if isinstance(k, Node) else out.words(k, keep)
            continue
        if hidden(k, out.sheet):
            continue
        if node.tag == "ol" and (given := whole(k.attrs.get("value"))) is not None:
            count = given
        mark = f"{count}. " if node.tag == "ol" else "- "
        count += -1 if back else 1
        text = render(k, out.sheet, out.seen)
        for i, line in enumerate(text.split("\n") if text else []):
            out.gap(1)
            out.put((mark if not i else " " * len(mark)) + line) if line else out.line()
        out.gap(1)


def _options(select: Node) -> list[Node]:
    """The options that a closed list shows: those chosen, else the first; an open list shows all."""
    found, todo = [], list(reversed(select.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            found += [k] if k.tag == "option" else []
            todo += reversed(k.kids) if k.tag != "option" else []
    if "multiple" in select.attrs or select.attrs.get("size", "1") not in ("", "0", "1"):
        return found
    return [k for k in found if "selected" in k.attrs][-1:] or found[:1]


def _summary(details: Node) -> list[Node]:
    """What closed details show."""
    return [k for k in details.kids if isinstance(k, Node) and k.tag == "summary"][:1]


def _render(node: Node, out: _Out, keep: bool) -> None:
    if hidden(node, out.sheet):
        return
    seen = out.seen
    out.seen = _seen(node, out)
    tag = node.tag
    if tag == "br":
        out.line()
    elif tag == "hr":
        out.gap(1)
        if out.seen:
            out.put("---")
        out.gap(1)
    elif tag == "input":
        if node.attrs.get("type", "").lower() in FIELDS and node.attrs.get("value"):
            out.words(node.attrs["value"], False)
    else:
        block = tag in BLOCK
        if block:
            out.gap(2 if tag in SPACED else 1)
        if tag == "table":
            _table(node, out, keep)
        elif tag in ("ul", "ol", "menu", "dir"):
            _list(node, out, keep)
        else:
            keep = keep or tag == "pre" or tag == "textarea"
            for k in _options(node) if tag == "select" else _summary(node) if tag == "details" and "open" not in node.attrs else node.kids:
                if isinstance(k, Node):
                    _render(k, out, keep)
                else:
                    out.words(k, keep)
        if block:
            out.gap(2 if tag in SPACED else 1)
    out.seen = seen


def render(node: Node, sheet: Sheet | None = None, seen: bool = True) -> str:
    """The text of what is in the node; a page's style sheets are its own unless they are given."""
    out = _Out(Sheet(node) if sheet is None else sheet, seen)
    out.seen = _seen(node, out)
    for k in node.kids:
        if isinstance(k, Node):
            _render(k, out, node.tag == "pre")
        else:
            out.words(k, node.tag == "pre")
    return "\n".join(out.done()).strip("\n")


def page_title(root: Node) -> str | None:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "title":
            return _SPACE.sub(" ", "".join(k for k in n.kids if isinstance(k, str))).strip()
        todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return None


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices(batch, "html")):
        titles, texts = [], []
        for markup in part.column(1).to_pylist():
            root = parse(markup) if markup is not None else None
            titles.append(page_title(root) if root else None)
            texts.append(render(root) if root else None)
        yield pa.record_batch({"page_id": part.column(0), "title": pa.array(titles, pa.string()), "text": pa.array(texts, pa.string())})


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row ``page_id, title, text``: all visible text, laid out.

    Null markup gives null title and text, empty markup empty text. Broken markup is read as far
    as it goes: unclosed tags, comments and quotes end with the page. Rows that repeat are each
    rendered; extra columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return in_batches(rows, _extract, "page_id long, title string, text string")
