"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags make a tree; visibility rules take parts of it out; a renderer walks
what is left and writes all visible text: blocks on lines of their own, a blank line between paragraphs, list markers
with indentation, preformatted text as it is, and table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: elements by their role in HTML -----------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("textarea title".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas object area param source track".split())
#: Blocks with a blank line around them, and blocks with a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table menu dir hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center details dialog div dd dt figcaption footer form header hgroup legend li main nav optgroup "
    "option search section summary caption colgroup col tbody thead tfoot tr td th".split())
#: An open paragraph ends before these.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr li main menu nav ol p pre search section summary table ul xmp".split())
#: Opening a tag closes these open elements, looked for up to the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag does not reach past these.
SCOPE = frozenset("table td th caption template html".split())
#: SVG shows the text of these only, and nothing of what is kept for reference or made known to others.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_UNSEEN = frozenset("defs symbol clippath mask marker pattern lineargradient radialgradient filter metadata desc title".split())
#: Inside these, SVG and MathML hold HTML again.
TO_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
#: HTML start tags that end an open svg or math.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split())
#: Parts of these formulas stand apart.
MATH_PARTS = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtable mtr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
# --------------------------------------------------------------------------------------------------

TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"([^\s/=\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CSS_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
CSS_SKIP = re.compile(rf"({CSS_STRING})|/\*.*?(?:\*/|\Z)|<!--|-->|<!\[CDATA\[|\]\]>", re.S)
CSS_MARK = re.compile(rf"{CSS_STRING}|\\.|[{{}};]|\Z", re.S)
CSS_ESCAPE = re.compile(r"\\(?:([0-9a-f]{1,6})\s?|(.))", re.I | re.S)
DECLARED = re.compile(r"(?:\A|;)\s*(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
MEDIA = re.compile(r"(?:(not|only)\s+)?([a-z-]+)(\s+and\b.*)?\Z", re.I | re.S)
PART = re.compile(r"([.#])((?:[\w-]|\\[0-9a-f]{1,6}\s?|\\.)+)|\[\s*([\w-]+)\s*(?:([~|^$*]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|(::?)([\w-]+)(\((?:[^()]|\([^()]*\))*\))?|(\*|[a-z][\w-]*)", re.I)
COMBINED = re.compile(r"\s*([>+~])\s*|\s+")
#: Not so when a page is opened, or of text that is not in the page.
NEVER = frozenset("hover focus focus-within focus-visible active before after first-line first-letter".split())
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "state", "space", "here", "above")

    def __init__(self, tag: str, attrs: str = "", space: str = ""):
        self.tag, self.attrs, self.children, self.state, self.space = tag, attrs, [], "", space
        self.here = self.above = frozenset()  # steps of selectors that end at the node, and at the nodes around it

    def get(self, name: str) -> str | None:
        """Value of an attribute, '' without one, None if it is absent."""
        if name not in self.attrs.lower():
            return None
        for m in ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text with its content in ``rest``, open and close tags, and raw content of raw elements."""
    at, n, foreign = 0, len(page), 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if page.find(">", lt) < 0:  # no tag can end any more
            yield "text", "", page[at:lt] if page.startswith("<!--", lt) else page[at:]
            return
        if foreign and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            end = n if end < 0 else end
            yield "text", "", page[at:lt]
            yield "text", "", page[lt + 9:end].replace("&", "&amp;")
            at = end + 3
            continue
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if m is None:  # a lone "<" is text
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            yield "text", "", page[at:nxt]
            at = nxt
            continue
        if lt > at:
            yield "text", "", page[at:lt]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            foreign = max(0, foreign - (name in TO_HTML))
            continue
        yield "open", name, m[3]
        if foreign and m[3].endswith("/"):
            continue
        foreign += name in TO_HTML and not m[3].endswith("/")
        if name in RAW or name in RCDATA:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop = end.start() if end else n
            yield "text" if name in RCDATA else "raw", name, page[at:stop]
            yield "close", name, ""
            at = end.end() if end else n
        elif name == "plaintext":
            yield "text", "", page[at:]
            return


#: End tags that reach through a cell or another scope.
THROUGH = {"table", "tbody", "thead", "tfoot", "tr"}


def build(page: str) -> Node:
    """The tree of a page; tags that may be left out are implied."""
    root = Node("html")
    stack = [root]
    # how many of each tag are open: in all, and from the innermost scope on; a search that would find none is not made,
    # and one that finds closes what it walked over, so that nesting costs no more than its depth
    open_: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]
    last_p = [0]  # for each open node the place of the p that a block inside it ends, or 0

    def pop_to(i: int) -> None:
        for node in stack[i:]:
            open_[node.tag] -= 1
        for node in reversed(stack[i:]):
            scopes[-1][node.tag] -= 1
            if node.tag in SCOPE:
                scopes.pop()
        del stack[i:], last_p[i:]

    def pop() -> None:
        pop_to(len(stack) - 1)

    def close_open(tags: set[str], until: set[str]) -> None:
        if not any(scopes[-1][t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                found = i
                while found > 1 and stack[found - 1].tag in tags:
                    found -= 1
                pop_to(found)
                return
            if stack[i].tag in until or stack[i].tag in SCOPE:
                return

    def end_p() -> None:
        if last_p[-1]:
            pop_to(last_p[-1])

    def inner() -> str:
        """svg or math, if the next tag is one of theirs."""
        top = stack[-1]
        return "" if top.tag in TO_HTML.get(top.space, ()) else top.space

    def push(tag: str, attrs: str = "") -> None:
        node = Node(tag, attrs, tag if tag in TO_HTML else inner())
        stack[-1].children.append(node)
        last_p.append(len(stack) if tag == "p" else 0 if tag in SCOPE or tag == "button" else last_p[-1])
        stack.append(node)
        open_[tag] += 1
        if tag in SCOPE:
            scopes.append(Counter())
        scopes[-1][tag] += 1

    for kind, name, rest in tokens(page):
        if kind == "text":
            if stack[-1].tag == "head" and rest.strip():
                pop()  # text ends an open head
            if rest:
                stack[-1].children.append(html.unescape(rest) if "&" in rest else rest)
        elif kind == "raw":
            stack[-1].children.append(rest)
        elif kind == "open":
            if name == "html":
                root.attrs = root.attrs or rest
                continue
            if name in BREAKS_OUT:
                while inner():
                    pop()
            if stack[-1].tag == "head" and name not in UNSEEN and name not in ("base", "link", "meta", "basefont", "bgsound"):
                pop()  # content ends an open head
            if name in ENDS_P:
                end_p()
            if name in CLOSES:
                close_open(*CLOSES[name])
            if name == "tr" and stack[-1].tag == "table":
                push("tbody")
            elif name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if stack[-1].tag == "table":
                    push("tbody")
                push("tr")
            push(name, rest)
            if name in VOID or (stack[-1].space and rest.endswith("/")):
                pop()
        elif not (open_ if name in THROUGH else scopes[-1])[name]:
            if name in ("p", "br") and len(scopes) == 1:
                push(name)
                pop()
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    pop_to(i)
                    break
                if stack[i].tag in SCOPE and name not in THROUGH:
                    break
                if name in FORMATTING and stack[i].tag in BLOCK:
                    break  # a stray inline end tag does not close blocks
    return root


def media(query: str) -> bool | None:
    """Whether a media query list holds on a screen; None if that depends on the screen."""
    found = []
    for q in query.split(",") if query.strip() else ["all"]:
        m = MEDIA.match(q.strip())
        if m is None or m[2].lower() in ("not", "only"):
            found.append(None)
            continue
        on = m[2].lower() in ("screen", "all")
        on = None if on and m[3] else on
        found.append(not on if (m[1] or "").lower() == "not" and on is not None else on)
    return True if True in found else None if None in found else False


def declared(body: str) -> list[tuple[str, str, bool]]:
    """(display or visibility, value, important): the declaration that counts of each property."""
    out: dict[str, tuple[str, bool]] = {}
    for name, value, strong in DECLARED.findall(re.sub(CSS_STRING, "", body)):
        name = name.lower()
        if strong or not out.get(name, ("", False))[1]:
            out[name] = (value.lower(), bool(strong))
    return [(k, *v) for k, v in out.items()]


class Rules:
    """Display and visibility rules of the style elements, asked node by node from the root down.

    A selector is a chain of steps. A step ends at a node that its compound fits, if the step before ended at a node
    around it (or at its parent), so every node is looked at once per step that its tag, a class or its id can fit.
    What depends on the reader's screen or on states of the page only ever shows text.
    """

    def __init__(self, root: Node):
        self.steps: dict[str, list[tuple]] = {}  # key of the compound -> (step, parts, combinator, step before)
        self.found: dict[int, list[tuple]] = {}  # last step -> (property, value, weight)
        self.layers: dict[str, int] = {}
        self.order = self.count = 0
        styles, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag in ("noscript", "template", "iframe"):
                continue
            if node.tag == "style":
                styles.append(node)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        for node in styles:
            text = "".join(c for c in node.children if isinstance(c, str))
            on = media(node.get("media") or "") if (node.get("type") or "text/css").strip().lower() == "text/css" else False
            if on is not False and re.search("display|visibility", text, re.I):
                self.read(CSS_SKIP.sub(r"\1", text), on)

    def read(self, css: str, sure: bool | None) -> None:
        """Add the rules of a style sheet; ``sure`` is None if it may not apply."""
        top = ("block", "", sure, "")  # kind, selectors, sure, layer
        stack, bodies, last = [top], [[]], 0
        for m in CSS_MARK.finditer(css):
            if m[0] and m[0] not in "{};":
                continue
            piece, end = css[last:m.start()].strip(), m[0]
            kind, selectors, sure, layer = stack[-1]
            if end == ";" and kind != "rule" and not piece.startswith("@"):
                continue
            last = m.end()
            word = re.match(r"@([\w-]*)\s*", piece)
            if end == "{":
                rest = piece[word.end():] if word else ""
                name = word[1].lower() if word else ""
                if kind == "skip" or name in ("font-face", "page", "property", "counter-style", "font-feature-values") or name.endswith("keyframes"):
                    new = ("skip", "", sure, layer)
                elif name == "media":
                    on = media(rest)
                    new = ("skip" if on is False else kind, selectors, None if on is None else sure, layer)
                elif name == "layer":
                    path = f"{layer}.{rest.strip() or len(self.layers)}"
                    self.layers.setdefault(path, len(self.layers))
                    new = (kind, selectors, sure, path)
                elif word:
                    new = (kind, selectors, None, layer)
                elif kind == "rule":
                    new = ("rule", piece.replace("&", " "), None, layer)
                else:
                    new = ("rule", piece, sure, layer)
                stack.append(new)
                bodies.append([])
            else:
                if word and word[1].lower() == "layer":
                    for x in piece[word.end():].split(","):
                        self.layers.setdefault(f"{layer}.{x.strip()}", len(self.layers))
                bodies[-1].append(piece)
                while end != ";" and len(stack) > 1:
                    kind, selectors, sure, layer = stack.pop()
                    body = ";".join(bodies.pop())
                    if kind == "rule":
                        self.add(selectors, body, sure, layer)
                    if end == "}":
                        break

    def add(self, selectors: str, body: str, sure: bool | None, layer: str) -> None:
        self.order += 1
        values = declared(body)
        if not values:
            return
        for selector in re.split(r",(?![^(\[]*[)\]])", selectors):
            chain, weight, known = self.chain(selector.strip())
            if not chain:
                continue
            kept = []
            for name, value, strong in values:
                if value in ("none", "hidden", "collapse") and not (known and sure):
                    continue
                rank = self.layers[layer] if layer else 1 << 30
                kept.append((name, value, (strong, -rank if strong else rank, False, weight, self.order)))
            if not kept:
                continue
            before = -1
            for key, parts, how in chain:
                self.steps.setdefault(key, []).append((self.count, parts, how, before))
                before = self.count
                self.count += 1
            self.found[before] = kept

    @staticmethod
    def chain(selector: str) -> tuple[list[tuple], tuple[int, int, int], bool]:
        """(key, parts, combinator) of each compound, the specificity, and whether the chain says all that the selector says."""
        chain, parts, how, at, weight, known = [], [], "", 0, [0, 0, 0], True

        def done() -> None:
            key = next((f"{k}{v}" for t in "#." for k, v, *_ in parts if k == t), None) or next((v for k, v, *_ in parts if k == "tag"), "*")
            chain.append((key, tuple(parts), how))

        while at < len(selector):
            m = PART.match(selector, at)
            if m is None:
                m = COMBINED.match(selector, at)
                if m is None:
                    return [], (0, 0, 0), False
                known &= bool(parts) and m[1] not in ("+", "~")
                if parts:
                    done()
                parts, how, at = [], m[1] or " ", m.end()
                continue
            at = m.end()
            if m[1]:
                parts.append((m[1], CSS_ESCAPE.sub(lambda e: chr(min(int(e[1], 16), 0x10FFFF)) if e[1] else e[2], m[2])))
                weight[0 if m[1] == "#" else 1] += 1
            elif m[3]:
                parts.append(("[", m[3].lower(), "=" if m[4] == "" and "=" in m[0] else m[4] or "", m[5] or m[6] or m[7] or ""))
                weight[1] += 1
            elif m[8]:
                if m[8] == "::" or m[9].lower() in NEVER:
                    return [], (0, 0, 0), False
                known = False
                weight[1] += 1
            elif m[11] != "*":
                parts.append(("tag", m[11].lower()))
                weight[2] += 1
            else:
                parts.append(("*", ""))
        if not parts:  # a pseudo-class alone says nothing of the node
            return [], (0, 0, 0), False
        done()
        return chain, tuple(weight), known

    def of(self, node: Node, parent: Node) -> dict[str, tuple[str, tuple]]:
        """The winning (value, weight) of display and visibility in the rules that fit a node."""
        out: dict[str, tuple[str, tuple]] = {}
        if not self.steps:
            return out
        node.above = parent.above if parent.here <= parent.above else parent.above | parent.here
        name, classes = node.get("id"), set((node.get("class") or "").split())
        here = set()
        tags = ("html", "body") if parent is node else (node.tag,)  # the root is the body too where no tag opens one
        fits = [s for key in ("*", *tags, *(f".{c}" for c in classes), f"#{name}") for s in self.steps.get(key, ())]
        for step, parts, how, before in sorted(fits):
            if before >= 0 and not (before in node.above if how == " " else before in parent.here if how == ">" else True) and not (parent is node and before in here):
                continue
            if not all(
                v in tags if k == "tag" else v in classes if k == "." else v == name if k == "#" else k == "*" or has(node.get(v), *rest)
                for k, v, *rest in parts
            ):
                continue
            here.add(step)
            for prop, value, weight in self.found.get(step, ()):
                if prop not in out or weight >= out[prop][1]:
                    out[prop] = (value, weight)
        node.here = frozenset(here)
        return out


def has(got: str | None, how: str, want: str) -> bool:
    """Whether an attribute fits an attribute selector."""
    if got is None or not how:
        return got is not None
    if how == "=":
        return got == want
    if how == "~":
        return want in got.split()
    if how == "|":
        return got == want or got.startswith(f"{want}-")
    return bool(want) and (got.startswith(want) if how == "^" else got.endswith(want) if how == "$" else want in got)


def visibility(node: Node, parent: Node, rules: Rules) -> str:
    """'none' (the node and all below), 'hidden' (unless something below is shown), or ''."""
    state, tag = parent.state, node.tag
    if tag in UNSEEN or (parent.tag == "details" and tag != "summary" and parent.get("open") is None):
        return "none"
    if node.space == "svg" and tag in SVG_UNSEEN:
        return "none"
    if parent.tag in ("semantics", "maction") and parent.space == "math" and next(c for c in parent.children if isinstance(c, Node)) is not node:
        return "none"
    won = rules.of(node, parent)
    if node.attrs and "style" in node.attrs.lower():
        for name, value, strong in declared(CSS_SKIP.sub(r"\1", node.get("style") or "")):
            weight = (strong, 0 if strong else 1 << 30, True)
            if name not in won or weight[0] > won[name][1][0] or weight[0] == won[name][1][0]:
                won[name] = (value, weight)
    if node.space == "svg" and node.attrs:  # attributes give way to rules
        for name in ("display", "visibility"):
            value = node.get(name)
            if value and name not in won:
                won[name] = (value.strip().lower(), ())
    if "display" in won:
        if won["display"][0] == "none":
            return "none"
    elif node.attrs and node.get("hidden") is not None or tag == "dialog" and node.get("open") is None:
        return "none"
    seen = won["visibility"][0] if "visibility" in won else "hidden" if tag == "mphantom" else ""
    return "hidden" if seen in ("hidden", "collapse") else "" if seen in ("visible", "initial") else state


def shown_in(node: Node) -> bool:
    """Whether text right in a node can be seen: SVG shows that of its text elements only."""
    return node.space != "svg" or node.tag in SVG_TEXT or node.tag in ("tspan", "textpath", "a")


def apart(node: Node, parent: Node) -> bool:
    """Whether a part of a drawing or formula stands apart from what is around it."""
    if node.space == "svg":
        return node.tag in SVG_TEXT or node.tag == "tspan" and any(node.get(x) is not None for x in ("x", "y", "dy"))
    return node.tag == "math" or parent.space == "math" and parent.tag in MATH_PARTS


class Flow:
    """Text being set: blank lines and spaces wait until text follows them."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.space, self.fresh = 0, False, True
        self.prefix: list[str] = []
        self.marker: str | None = None

    def line(self, blank: bool = False) -> None:
        if self.out:
            self.gap = max(self.gap, 2 if blank else 1)
        self.space, self.fresh = False, True

    def lead(self) -> None:
        if self.gap and self.out:
            self.out.append("\n" * self.gap)
        self.gap = 0
        if self.fresh:
            lead = "".join(self.prefix)
            if self.marker is not None:
                lead = lead[: len(lead) - len(self.prefix[-1])] + self.marker if self.prefix else self.marker
                self.marker = None
            self.out.append(lead)
            self.fresh = False

    def words(self, s: str) -> None:
        parts = SPACES.sub(" ", s)
        body = parts.strip(" ")
        if not body:
            self.space |= bool(parts)
            return
        if (self.space or parts[0] == " ") and not self.fresh:
            self.out.append(" ")
        self.lead()
        self.out.append(body)
        self.space = parts[-1] == " "

    def exact(self, s: str) -> None:
        for i, piece in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                if self.out:
                    self.gap += 1
                self.fresh = True
            if piece:
                self.lead()
                self.out.append(piece)

    def text(self) -> str:
        return "".join(self.out).replace(" ", " ")


def spanned(value: str | None, most: int) -> int:
    """Columns or rows that a cell takes."""
    return min(int(value), most) if value and value.isdigit() and int(value) else 1


def gridded(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Rows of (text, columns), with an empty cell where one from a row above reaches down."""
    out, held = [], {}  # column -> rows that are still taken there
    for row in rows:
        cells, at, todo, last = [], 0, list(reversed(row)), max(held, default=-1)
        while todo or at <= last:
            if at in held:
                cells.append(("", 1))
                at += 1
            elif todo:
                text, wide, tall = todo.pop()
                cells.append((text, wide))
                if tall > 1:
                    held |= {c: tall for c in range(at, at + wide)}
                at += wide
            else:  # columns that neither this row nor one above fills
                cells.append(("", 1))
                at += 1
        held = {c: n - 1 for c, n in held.items() if n > 1}
        out.append(cells)
    return out


def rows_of(flow_cells: list[list[tuple[str, int]]]) -> str:
    """Cells of a table as aligned columns; cells of several lines are set side by side."""
    grid, widths = [], []
    for row in flow_cells:
        line, col = [], 0
        for text, span in row:
            lines = text.split("\n") if text else [""]
            line.append((col, lines))
            if span == 1:
                widths += [0] * (col + 1 - len(widths))
                widths[col] = max(widths[col], max(map(len, lines)))
            col += span
        widths += [0] * (col - len(widths))
        grid.append(line)
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + (w + 2 if w else 0))
    out = []
    for line in grid:
        for k in range(max((len(lines) for _, lines in line), default=0)):
            s = ""
            for col, lines in line:
                if k < len(lines) and lines[k]:
                    if s:
                        s = s.ljust(max(starts[col], len(s) + 2))
                    else:
                        s = " " * starts[col]
                    s += lines[k]
            out.append(s.rstrip())
    while out and not out[0]:
        out.pop(0)
    return "\n".join(out).rstrip("\n")


def render(page: str | None) -> str:
    """All visible text of a page, set as a reader would see its blocks, lists and tables."""
    if not page:
        return ""
    root = build(page)
    rules = Rules(root)
    rules.of(root, root)
    flow, flows = Flow(), []
    tables: list[list[list[tuple[str, int]]]] = []
    lists: list[list] = []  # [ordered, next number]
    pre = 0
    todo: list[tuple[Node | str, Node | None, bool]] = [(root, root, True)]
    while todo:
        node, parent, entering = todo.pop()
        if isinstance(node, str):
            if parent.tag == "details" and parent.get("open") is None or not shown_in(parent):
                continue
            if not parent.state and parent.tag not in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "colgroup"):
                flow.exact(node) if pre else flow.words(node)
            elif not parent.state and node.strip():
                flow.words(node)
            continue
        tag = node.tag
        if entering:
            if node is not root:
                node.state = visibility(node, parent, rules)
                if node.state == "none":
                    continue
            if tag == "br":
                if not node.state:
                    flow.lead() if flow.fresh and not flow.gap and flow.out else None
                    flow.gap = flow.gap + 1 if flow.out else 0
                    flow.fresh, flow.space = True, False
                continue
            if tag == "hr":
                flow.line(True)
                continue
            if tag == "input":
                kind = (node.get("type") or "text").lower()
                if kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and not node.state:
                    flow.words(f" {node.get('value') or ''} ")
                continue
            todo.append((node, parent, False))
            if apart(node, parent):
                flow.space = True
            if tag == "table":
                flow.line(True)
                tables.append([])
                flows.append(flow)
                flow = Flow()
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(flow)
                flow = Flow()
            elif tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and bool(lists)
                flow.line(tag in SPACED and not nested)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.get("start") if tag == "ol" else None
                lists.append([tag == "ol", int(start) if start and start.strip().isdigit() else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    value = node.get("value")
                    lists[-1][1] = int(value) if value and value.strip().isdigit() else lists[-1][1]
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.prefix.append(" " * len(mark))
                flow.marker = mark
            elif tag in ("dd", "blockquote"):
                flow.prefix.append("  ")
            if tag in ("pre", "textarea", "xmp"):
                pre += 1
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")  # a line end after the tag is not shown
            todo += [(c, node, True) for c in reversed(node.children)]
            continue
        pre -= tag in ("pre", "textarea", "xmp")
        if apart(node, parent):
            flow.space = True
        if tag in ("ul", "ol", "menu", "dir"):
            nested = len(lists) > 1
            lists.pop()
            flow.line(not nested)
        elif tag in ("td", "th") and tables:
            done = flow.text()
            flow = flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((done, spanned(node.get("colspan"), 1000), spanned(node.get("rowspan"), 65534)))
        elif tag == "table":
            around, rows = flow.text(), tables.pop()
            flow = flows.pop()
            for part in (around, rows_of(gridded(rows))):  # a caption or stray text comes before the cells
                if part:
                    for line in part.split("\n"):
                        flow.line()
                        if line:
                            flow.lead()
                            flow.out.append(line)
                        else:
                            flow.gap += 1
            flow.line(True)
        elif tag == "li":
            flow.prefix.pop()
            flow.marker = None
            flow.line()
        elif tag in ("dd", "blockquote"):
            flow.prefix.pop()
            flow.line(tag == "blockquote")
        elif tag in BLOCK:
            flow.line(tag in SPACED)
        elif tag in ("button", "select", "textarea", "label"):
            flow.space = True
    return "\n".join(x.rstrip(" ") for x in flow.text().split("\n")).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the page by default) and ``text``, for every row.

    A null or empty page gives an empty text, as does one with nothing to see; repeated rows give repeated results.
    A kept column named ``text`` is given as ``text_in``. Unclosed tags, comments and quotes end with the page.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    given = pages.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(keep)], F.col(f"`{html_col}`").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                texts = pa.array([render(x) for x in part.column("page").to_pylist()], pa.string())
                yield pa.record_batch([*part.columns[:-1], texts], names=[*part.schema.names[:-1], "text"])

    lead = "".join(f"x{i} {given.schema[f'x{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    names = ["text_in" if c == "text" else c for c in keep]
    return given.mapInArrow(run, f"{lead}text string").select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(names)], "text")
