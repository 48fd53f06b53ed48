"""Layout-aware text of HTML pages.

A page is cut into tags and text, and a tree is built from them with HTML's
implied tags: head elements before the body, void elements, end tags that are
left out (p, li, dt, dd, option, table parts), tables with implied rows and
bodies, and end tags that match nothing. The tree is then laid out: inline text
flows with white space collapsed, blocks stand on lines of their own with a
blank line around paragraphs and headings, list items have bullets or numbers and
are indented by depth, preformatted text keeps its spaces, and the cells of a
table are padded to the width of their column.

Not visible: head contents, script, style, template, noscript and what other
media, progress bars and meters hold in place of themselves, parentheses of ruby
text, dialogs that are not open, descriptions and definitions inside drawings
and formulas (their labels are visible), comments, elements with `hidden`, hidden
inputs, `display:none`, text whose nearest `visibility` is hidden or collapse (a
descendant that says visible is seen), and closed details apart from their
summary. `aria-hidden=true` hides from screen readers only: such text is painted
and kept where `painted` is set, as the query does. All other text is emitted
once and in order, whatever it is.

Cells keep their columns: one that spans rows leaves its place free in the rows
below. The work grows with the length of a page, not with its depth, but for end
tags that a table or cell keeps from their element.

A null html gives a null text, an empty one an empty text. Nesting is not limited
(the tree is walked without recursion). Repeated rows each get a row; other
columns are ignored, whatever their names; a null page_id is kept; very long
pages are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.llm.common import prepare

OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)[a-zA-Z]")
NAME_END, SPECIAL = re.compile(r"[\s/>]"), re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe audio video canvas datalist progress meter rp title meta link base desc metadata defs symbol clippath mask pattern annotation annotation-xml".split())
HEAD = frozenset("base link meta script style template title noscript".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody thead tfoot tr td th caption ul xmp".split())
SPACED_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr address menu dir".split())
ENDS_P = BLOCK - frozenset("html body dd dt li option optgroup legend td th tr tbody thead tfoot caption summary".split()) | frozenset(["dd", "dt", "li", "summary"])

#: By tag: the open tags it ends by itself, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
TABLE_PARENTS = {"td": ("tr", {"tr"}), "th": ("tr", {"tr"}), "tr": ("tbody", {"tbody", "thead", "tfoot"})}
#: Kinds of inputs that show what is written in them, or else their placeholder.
WRITTEN = ("text", "search", "email", "url", "tel", "number")
SCOPE = frozenset(["table", "td", "th", "caption", "html", "body", "template"])


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Ahead:
    """The next place of a pattern from a place on; it is searched for once, however many places ask for it."""

    def __init__(self, page: str, pattern: re.Pattern):
        self.page, self.pattern, self.since, self.at = page, pattern, 0, -1

    def __call__(self, place: int) -> int:
        if not self.since <= place <= self.at:
            found = self.pattern.search(self.page, place)
            self.since, self.at = place, found.start() if found else len(self.page)
        return self.at


class Scanner:
    """Cuts a page into tags, comments and CDATA. No byte is read more than a few times, also where tags or quotes never end."""

    def __init__(self, page: str):
        self.page = page
        self.name_end, self.special = _Ahead(page, NAME_END), _Ahead(page, SPECIAL)
        #: Places of marks from which no tag ends.
        self.dead: set[int] = set()

    def _tag_end(self, place: int) -> int:
        """Where the tag ends whose attributes begin at a place: at the first > outside quotes; -1 if there is none."""
        page, been = self.page, []
        while (s := self.special(place)) < len(page) and s not in self.dead:
            if page[s] == ">":
                return s
            been.append(s)
            place = page.find(page[s], s + 1) + 1
            if not place:
                break
        self.dead.update(been)
        return -1

    def next(self, at: int) -> tuple[int, int, str | None, str, str, str] | None:
        """(first, end, text of CDATA, / of an end tag, tag, attributes) of what comes next; no tag for what is left out."""
        page, n = self.page, len(self.page)
        while m := OPENING.search(page, at):
            first, opened = m.start(), m[0]
            if opened == "<!--":
                end = page.find("-->", m.end())
                return first, n if end < 0 else end + 3, None, "", "", ""
            if opened == "<![CDATA[":
                end = page.find("]]>", m.end())
                return first, n if end < 0 else end + 3, page[m.end() : n if end < 0 else end], "", "", ""
            if opened in ("<!", "<?"):
                end = page.find(">", m.end())
                return first, n if end < 0 else end + 1, None, "", "", ""
            begin = m.end() - 1
            name = self.name_end(begin)
            end = self._tag_end(name)
            if end >= 0:
                return first, end + 1, None, m[1], page[begin:name].lower(), page[name:end]
            at = m.end()
        return None


def parse(page: str) -> Node:
    """The element tree of a page; kids are nodes and strings."""
    root = Node("html", {})
    body = Node("body", {})
    stack = [root]
    #: How many elements of each tag are open: a search for none is not begun.
    open_tags: Counter = Counter()

    def push(node: Node) -> None:
        stack.append(node)
        open_tags[node.tag] += 1

    def top(tag: str | None) -> None:
        """Head contents stay in the head until anything else comes: that begins the body."""
        if len(stack) == 1 or stack[-1].tag == "head" and tag not in HEAD:
            if tag in HEAD and body not in root.kids and len(stack) == 1:
                head = Node("head", {})
                root.kids.append(head)
                push(head)
            elif tag is None or tag not in HEAD or len(stack) == 1:
                close(1)
                if body not in root.kids:
                    root.kids.append(body)
                push(body)

    def close(upto: int) -> None:
        while len(stack) > upto:
            open_tags[stack.pop().tag] -= 1

    def add(text: str) -> None:
        if text:
            if len(stack) == 1 or stack[-1].tag == "head":
                if not text.strip(" \t\n\r\f"):
                    return
                top(None)
            stack[-1].kids.append(text)

    at, n = 0, len(page)
    scanner = Scanner(page)
    for_raw = None
    while at < n:
        if for_raw:
            end = re.compile(rf"</{re.escape(for_raw)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                text = page[at:stop]
                stack[-1].kids.append(entities.unescape(text) if for_raw in ("textarea", "title") else text)
            at, for_raw = stop, None
            if not end:
                break
        found = scanner.next(at)
        if not found:
            add(entities.unescape(page[at:]))
            break
        first, end, cdata, closing, tag, own = found
        if first > at:
            add(entities.unescape(page[at:first]))
        at = end
        if cdata is not None:
            add(cdata)
        if not tag:
            continue
        if closing:
            if tag in ("html", "body"):
                continue
            if tag == "p" and not open_tags["p"]:
                top(tag)
                stack[-1].kids.append(Node("p", {}))
                continue
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
                continue
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "body", "html"):
                    break
            continue
        attrs = {a[1].lower(): entities.unescape(next((x for x in a.groups()[1:] if x is not None), "")) for a in ATTRIBUTE.finditer(own)} if own else {}
        if tag == "html":
            root.attrs |= attrs
            continue
        if tag == "body":
            top(tag)
            body.attrs |= attrs
            continue
        if tag == "head":
            if len(stack) == 1 and body not in root.kids:
                root.kids.append(Node("head", attrs))
                push(root.kids[-1])
            continue
        top(tag)
        if tag in ENDS_P and open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPE or stack[k].tag in BLOCK:
                    break
        if tag in ENDS:
            ended, stops = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(open_tags[x] for x in ended) else ():
                if stack[k].tag in stops:
                    break
                if stack[k].tag in ended:
                    close(k)
        if tag in TABLE_PARENTS and open_tags["table"]:
            chain, t = [], tag
            while t in TABLE_PARENTS and stack[-1].tag not in TABLE_PARENTS[t][1]:
                t = TABLE_PARENTS[t][0]
                chain.append(t)
            for t in reversed(chain):
                stack[-1].kids.append(Node(t, {}))
                push(stack[-1].kids[-1])
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag not in VOID and not own.rstrip().endswith("/") or tag in RAW:
            push(node)
            if tag in RAW:
                for_raw = tag
    return root


def _style(node: Node) -> dict[str, str]:
    """The last value of each property of the element's own style."""
    parts = (x.partition(":") for x in node.attrs.get("style", "").lower().split(";"))
    return {k.strip(" \t\n\r\f"): v.replace("!important", "").strip(" \t\n\r\f") for k, _, v in parts}


def visible(node: Node, painted: bool = False) -> bool:
    """Whether the element has a place in the layout; it may still say that its text is hidden."""
    a = node.attrs
    if node.tag in UNSEEN:
        return False
    if not a:
        return node.tag != "dialog"
    if "hidden" in a and a["hidden"].lower() != "until-found" or not painted and a.get("aria-hidden", "").lower() == "true":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return "style" not in a or _style(node).get("display") != "none"


class Flow:
    """Lines of text as they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.space = False
        self.prefix = ""
        self.marker = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *more = s.split("\n")
            self._put(first)
            for x in more:
                self._end(True)
                self._put(x)
            return
        parts = SPACE.split(s)
        for k, x in enumerate(parts):
            if k:
                self.space = bool(self.line)
            if x:
                self._put((" " if self.space else "") + x)
                self.space = False

    def _put(self, s: str) -> None:
        if s:
            if not self.line:
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.line.append(self.prefix + self.marker)
                self.prefix += " " * len(self.marker)
                self.marker = ""
            self.line.append(s)

    def _end(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif blank and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self._end()
        if spaced:
            self.gap = True

    def whole(self) -> str:
        self._end()
        return "\n".join(self.lines).strip("\n")


def render(root: Node, painted: bool = False) -> str:
    """The visible text. Each frame of the stack is a node, or what is done after it."""
    flows = [Flow()]
    tables: list[dict] = []
    stack: list = [root]
    state = {"pre": 0, "lists": [], "hidden": False}
    while stack:
        x = stack.pop()
        if callable(x):
            x()
            continue
        flow = flows[-1]
        if isinstance(x, str):
            if not state["hidden"]:
                flow.text(x, state["pre"] > 0)
            continue
        if not visible(x, painted):
            continue
        tag, kids = x.tag, x.kids
        seen = _style(x).get("visibility") if "style" in x.attrs else None
        if seen in ("hidden", "collapse", "visible") and (seen != "visible") != state["hidden"]:

            def after_hidden(before=state["hidden"]):
                state["hidden"] = before

            stack.append(after_hidden)
            state["hidden"] = seen != "visible"
        if tag == "br":
            flow._end(True)
            continue
        if tag in ("img", "input") and state["hidden"]:
            continue
        if tag == "img":
            if x.attrs.get("alt"):
                flow.text(x.attrs["alt"], False)
            continue
        if tag == "input":
            kind = x.attrs.get("type", "text").lower()
            shown = x.attrs.get("value") if kind in ("submit", "button", "reset", *WRITTEN) else None
            shown = shown or (x.attrs.get("placeholder") if kind in WRITTEN or kind == "password" else None)
            if shown:
                flow.text(shown, False)
            continue
        if tag == "hr":
            flow.block(True)
            continue
        if tag == "details" and "open" not in x.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag == "table":
            flow.block(True)
            tables.append({"rows": []})

            def after_table(flow=flow):
                t = tables.pop()
                flow.block(False)
                for line in _aligned(t["rows"]):
                    flow.text(line, True)
                    flow._end()
                flow.block(True)

            stack.append(after_table)
        elif tag == "tr" and tables:
            tables[-1]["rows"].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]["rows"]:
                tables[-1]["rows"].append([])
            flows.append(Flow())
            pre, state["pre"] = state["pre"], 0
            lists, state["lists"] = state["lists"], []
            across, down = (int(v) if v.isdecimal() and len(v) < 6 else 1 for v in (x.attrs.get("colspan", "1"), x.attrs.get("rowspan", "1")))
            # No rows at all mean all that are left.
            cell = (max(1, min(across, 1000)), down or 1 << 20)

            def after_cell(row=tables[-1]["rows"][-1], pre=pre, lists=lists, cell=cell):
                row.append((flows.pop().whole(), *cell))
                state["pre"], state["lists"] = pre, lists

            stack.append(after_cell)
        elif tag in BLOCK:
            spaced = tag in SPACED_BLOCK and not (tag in ("ul", "ol", "menu", "dir") and state["lists"])
            flow.block(spaced)
            prefix = flow.prefix
            if tag in ("ul", "ol", "menu", "dir"):
                begin = x.attrs.get("start", "1")
                state["lists"].append([tag, int(begin) if re.fullmatch(r"-?\d{1,9}", begin) else 1])
            elif tag == "li":
                if state["lists"] and state["lists"][-1][0] == "ol":
                    own = x.attrs.get("value", "")
                    if re.fullmatch(r"-?\d{1,9}", own):
                        state["lists"][-1][1] = int(own)
                    flow.marker = f"{state['lists'][-1][1]}. "
                    state["lists"][-1][1] += 1
                else:
                    flow.marker = "- "
            elif tag == "optgroup" and x.attrs.get("label"):
                kids = [Node("option", {}), *kids]
                kids[0].kids.append(x.attrs["label"])
            elif tag == "dd":
                flow.prefix += "  "
            elif tag == "blockquote":
                flow.prefix += "> "
            elif tag in ("pre", "xmp"):
                state["pre"] += 1
                if kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
                    kids = [kids[0][1:], *kids[1:]]

            def after_block(flow=flow, tag=tag, spaced=spaced, prefix=prefix):
                flow.block(spaced)
                flow.prefix, flow.marker = prefix, ""
                if tag in ("ul", "ol", "menu", "dir"):
                    state["lists"].pop()
                elif tag in ("pre", "xmp"):
                    state["pre"] -= 1

            stack.append(after_block)
        elif tag == "textarea":
            state["pre"] += 1

            def after_area():
                state["pre"] -= 1

            stack.append(after_area)
            first = kids[0] if kids and isinstance(kids[0], str) else ""
            kids = [first[1:] if first.startswith("\n") else first] if first.strip() else [x.attrs.get("placeholder", "")]
        elif tag == "q":
            kids = ["“", *kids, "”"]
        stack.extend(reversed(kids))
    return flows[0].whole()


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table (text, columns and rows of each cell): cells as wide as their column, their lines side by side."""
    width: dict[int, int] = {}
    #: By column that a cell from above still holds: rows it takes, this one included.
    held: dict[int, int] = {}
    placed: list[list[tuple[int, int, str]]] = []
    for row in rows:
        at, line = 0, []
        taken = dict(held)
        for text, span, down in row:
            while at in taken:
                at += 1
            line.append((at, span, text))
            if span == 1:
                width[at] = max(width.get(at, 0), max((len(x) for x in text.split("\n")), default=0))
            if down > 1:
                held.update((c, down) for c in range(at, at + span))
            at += span
        line += [(c, 1, "") for c in taken if not any(s <= c < s + n for s, n, _ in line)] if taken else []
        placed.append(sorted(line))
        held = {c: n - 1 for c, n in held.items() if n > 1}
    out = []
    for line in placed:
        cells = [(text.split("\n"), sum(width.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)) for at, span, text in line]
        for k in range(max((len(c) for c, _ in cells), default=0)):
            shown = " | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in cells).rstrip()
            if shown.strip(" |"):
                out.append(shown)
    return out


def extract(pages: DataFrame, painted: bool = False) -> DataFrame:
    """page_id, text of each row of pages (page_id, html); `painted`: with what is hidden from screen readers only."""
    prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = (None if x is None else render(parse(x), painted) for x in (v.as_py() for v in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string")


def digest(extracted: DataFrame) -> DataFrame:
    """page_id, text, n_lines, n_chars."""
    return extracted.select("page_id", "text", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))
