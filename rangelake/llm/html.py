"""Layout-aware text of HTML pages.

A tree builder with implied tags (unclosed paragraphs, list items, rows and cells; cells outside a
row) and visibility rules (elements that never show, ``hidden``, ``display:none`` and
``visibility`` in style attributes and in simple style-sheet rules) feeds a renderer that keeps
block spacing, list marks with indents, preformatted text and aligned table cells.  What stands in
a table outside its rows is shown before it; formulas and the texts of drawings are shown.  Pages are seen on a
screen of ``VIEWPORT`` pixels in light colours: media conditions are judged by that, and one that isn't known
doesn't hold.  Closed ``details`` show their summary, a ``dialog`` that isn't open nothing.

Work grows with the page: open elements are found by tag, ancestors that fit a selector are noted once, and tables
inside tables are laid out from the innermost on, at any depth.

Defined results: a null or empty page has an empty text; text without any tag is its own
rendering; broken markup is read as far as it goes.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, select, tune

#: Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
VIEWPORT = 1280
NEVER = frozenset("rp head script style template noscript iframe object canvas audio video datalist title meta link param source track noembed noframes area base col annotation annotation-xml".split())
#: Elements of a drawing that aren't drawn themselves.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
RAW = frozenset("script style noscript iframe noembed noframes template title textarea xmp".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr article section".split())
BLOCK = MARGIN | frozenset("html body div main header footer nav aside address li dt dd tr form details summary figcaption center dir menu legend option optgroup caption thead tbody tfoot td th xmp dialog".split())
CLOSES_P = BLOCK - frozenset("html body li dt dd tr td th thead tbody tfoot caption option optgroup legend".split())
#: Start tag -> open elements that it ends, and the elements that it doesn't look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
HEAD_ONLY = frozenset("head base link meta title style script noscript template html".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BRACE = re.compile(r"[{};]")
_SPACE = " \t\n\r\f"


class Node:
    __slots__ = ("tag", "attributes", "children", "up")

    def __init__(self, tag: str, attributes: dict[str, str], up: Node | None = None):
        self.tag, self.attributes, self.children, self.up = tag, attributes, [], up


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _declarations(style: str) -> tuple[dict[str, str], dict[str, str]]:
    """The declarations of a rule or style attribute: plain ones, and important ones."""
    plain, important = {}, {}
    for name, colon, value in (d.partition(":") for d in style.lower().split(";")):
        if colon:
            value = value.strip()
            bare = value.removesuffix("important").rstrip()
            is_important = value.endswith("important") and bare.endswith("!")
            (important if is_important else plain)[name.strip()] = bare[:-1].strip() if is_important else value
    return plain, important


_LENGTH = re.compile(r"(-?[\d.]+)(px|em|rem|cm|mm|in|pt)?\Z")
#: Pixels of a unit, and conditions that hold of the screen.
_PIXELS = {None: 1, "px": 1, "em": 16, "rem": 16, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72}
_HOLDS = {("orientation", "landscape"), ("prefers-color-scheme", "light"), ("hover", "hover"), ("any-hover", "hover"), ("pointer", "fine"), ("any-pointer", "fine"), ("scripting", "none"), ("update", "fast"), ("color", ""), ("hover", ""), ("pointer", ""), ("width", ""), ("height", "")}
_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


def _pixels(length: str) -> float | None:
    m = _LENGTH.match(length.strip())
    try:
        return float(m[1]) * _PIXELS[m[2]] if m else None
    except ValueError:
        return None


def _feature(text: str) -> bool:
    """Whether one bracketed condition holds."""
    text = text.strip()
    if parts := re.split(r"\s*([<>]=?)\s*", text)[:5]:
        if len(parts) in (3, 5):
            sides = [VIEWPORT if p.strip() == "width" else _pixels(p) for p in parts[::2]]
            return None not in sides and all(_COMPARE[parts[k]](sides[k // 2], sides[k // 2 + 1]) for k in range(1, len(parts), 2))
    name, _, value = (x.strip() for x in text.partition(":"))
    if name in ("min-width", "max-width", "width", "min-device-width", "max-device-width") and value:
        at = _pixels(value)
        return at is not None and (VIEWPORT >= at if name.startswith("min") else VIEWPORT <= at if name.startswith("max") else at == VIEWPORT)
    return (name, value) in _HOLDS


def _media(condition: str) -> bool:
    """Whether a list of media queries holds for the screen; brackets within brackets aren't read and don't hold."""
    for one in condition.split(",") if condition.strip() else ["all"]:
        one = one.strip()
        turned = re.match(r"not\s+(?=\w)", one)
        words = re.split(r"\s+(and|or)\s+", re.sub(r"^(?:not|only)\s+(?=\w)", "", one).strip())
        held = []
        for w in words[::2]:
            no = re.match(r"not\s*\(", w)
            w = w[3:].strip() if no else w
            held.append((_feature(w[1:-1]) if w.startswith("(") and w.endswith(")") else w in ("screen", "all")) != bool(no))
        if (any(held) if "or" in words[1::2] else all(held)) != bool(turned):
            return True
    return False


def _screen_rules(css: str):
    """(selector, declarations) of a style sheet in order; of conditional groups those that hold."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)
    shown, at, head = [True], 0, None  # one entry for each open group
    for m in _BRACE.finditer(css):
        text, at = css[at : m.start()].strip(), m.end()
        if m[0] == "{":
            if text.startswith("@"):
                word, condition = re.match(r"(@[\w-]*)(.*)", text.lower(), re.S).groups()
                holds = _media(condition) if word in ("@media", "@container") else not condition.strip().startswith("not") if word == "@supports" else word == "@layer"
                shown.append(shown[-1] and holds)
                head = None
            else:
                head, body = text, m.end()
                shown.append(shown[-1])
        elif m[0] == "}":
            if head is not None and shown[-1]:
                yield head, css[body : m.start()]
            head = None
            if len(shown) > 1:
                shown.pop()


_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*[is]?\s*)?\]|:not\(\s*([^()]*)\s*\)")
#: Compounds of a selector that is read.
MOST_COMPOUNDS = 32


def _compound(text: str):
    """(tag, classes, ids, tests) of a compound selector; a test is (name, operator, value) or a tuple of compounds that must not fit."""
    tag = re.match(r"\*|[a-zA-Z][\w-]*", text)
    at, classes, ids, tests = tag.end() if tag else 0, set(), set(), []
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            return None  # states, siblings
        at = m.end()
        if m[1]:
            (classes if m[1] == "." else ids).add(m[2])
        elif m[3]:
            tests.append((m[3].lower(), m[4], next((v for v in m.group(5, 6, 7) if v is not None), "")))
        else:
            inner = tuple(_compound(c.strip()) for c in m[8].split(",")) if ":not" not in m[8] else (None,)
            if None in inner:
                return None
            tests.append(inner)
    return (tag[0].lower() if tag and tag[0] != "*" else None, frozenset(classes), frozenset(ids), tuple(tests)) if text else None


_APART = re.compile(r"((?:[^\s>\[\]()]|\[[^\]]*\]|\([^)]*\))+)|\s*(>)\s*|\s+|(.)")


def _selector(one: str):
    """Pairs (compound, sign before it: ' ' or '>'), the last one first; None for what isn't read (states, siblings)."""
    out, sign = [], " "
    for m in _APART.finditer(one.strip()):
        if m[1]:
            c = _compound(m[1])
            if c is None:
                return None
            out.append((c, sign))
            sign = " "
        elif m[2]:
            sign = ">"
        elif m[3]:
            return None
    return tuple(reversed(out)) if 0 < len(out) <= MOST_COMPOUNDS else None


def _split_heads(heads: str) -> list[str]:
    """Selectors of a list; commas in brackets don't part it."""
    return re.findall(r"(?:[^,\[(]|\[[^\]]*\]?|\([^)]*\)?)+", heads)


def _add_rules(css: str, rules: dict) -> None:
    """Put a sheet's rules on display and visibility under a name that an element has to have for each."""
    for heads, text in _screen_rules(css):
        kinds = [{k: v for k, v in d.items() if k in ("display", "visibility")} for d in _declarations(text)]
        for one in _split_heads(heads) if any(kinds) else []:
            if s := _selector(one):
                tag, classes, ids, _ = s[0][0]
                key = "#" + min(ids) if ids else "." + min(classes) if classes else tag or "*"
                inner = [t for c, _ in s for t in c[3]]
                tests = sum(len(c[1]) for c, _ in s) + sum(isinstance(t[0], str) for t in inner)
                nots = [max((len(c[2]), len(c[1]) + len(c[3]), int(c[0] is not None)) for c in t) for t in inner if not isinstance(t[0], str)]
                weight = (sum(len(c[2]) for c, _ in s) + sum(n[0] for n in nots), tests + sum(n[1] for n in nots), sum(c[0] is not None for c, _ in s) + sum(n[2] for n in nots), rules.setdefault("", 0))
                rules[""] += 1
                rules.setdefault(key, []).append((weight, s, kinds))


def _test(a: dict[str, str], name: str, op: str | None, want: str) -> bool:
    if name not in a:
        return False
    v = a[name]
    if op is None:
        return True
    if op == "=":
        return v == want
    if op == "~=":
        return want in v.split()
    if op == "|=":
        return v == want or v.startswith(want + "-")
    return bool(want) and (v.startswith(want) if op == "^=" else v.endswith(want) if op == "$=" else want in v)


def _fits(node: Node, compound: tuple) -> bool:
    tag, classes, ids, tests = compound
    a = node.attributes
    if not ((tag is None or tag == node.tag) and (not ids or ids == {a.get("id")}) and (not classes or classes <= set(a.get("class", "").split()))):
        return False
    return all(_test(a, *t) if isinstance(t[0], str) else not any(_fits(node, c) for c in t) for t in tests)


def _applies(node: Node, selector: tuple, memo: dict, k: int = 0) -> bool:
    """Whether the selector's compounds from k on fit the element and those around it.

    Whether an element or one around it fits from k on is noted, so each element is asked once for each k.
    """
    if not _fits(node, selector[k][0]):
        return False
    if k + 1 == len(selector):
        return True
    if selector[k][1] == ">":
        return node.up is not None and _applies(node.up, selector, memo, k + 1)
    noted, path, up = memo.setdefault((selector, k + 1), {}), [], node.up
    while up is not None and id(up) not in noted:
        path.append(up)
        up = up.up
    held = noted[id(up)] if up is not None else False
    for n in reversed(path):
        held = noted[id(n)] = held or _applies(n, selector, memo, k + 1)
    return held


def parse(html: str) -> tuple[Node, dict]:
    """The tree, and style-sheet rules on display and visibility."""
    root = Node("#root", {})
    stack, rules, at = [root], {}, 0
    places: dict[str, list[int]] = {}  # of open elements by tag, and of blocks
    last_of = lambda name: places[name][-1] if places.get(name) else -1

    def push(node: Node) -> None:
        for name in (node.tag, "#block") if node.tag in BLOCK else (node.tag,):
            places.setdefault(name, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            tag = stack.pop().tag
            for name in (tag, "#block") if tag in BLOCK else (tag,):
                places[name].pop()

    def close(names: set[str], bounds: set[str]) -> None:
        bound = max(map(last_of, bounds))
        while (i := max(map(last_of, names))) > bound:
            cut(i)

    low, last = None, html.rfind(">") + 1  # no tag ends after that
    while m := _MARKUP.search(html, at, last):
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):  # never closed
            at = len(html)
            break
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            i = last_of(tag)
            # An inline end tag doesn't reach beyond a block; nothing reaches out of a cell but the table's own tags.
            if i > 0 and (tag in BLOCK or last_of("#block") < i) and (tag in ("tr", "table", "tbody", "thead", "tfoot") or max(last_of("td"), last_of("th")) <= i):
                cut(i)
            continue
        raw = m[3] if m[2] else m[6]
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        elif tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "caption", "li", "blockquote", "div", "section", "article", "#root"})
        if tag in ("td", "th") and stack[-1].tag not in ("tr",) and last_of("table") > 0 and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {}, stack[-1])
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, _attributes(raw) if raw.strip(" /") else {}, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            low = low or html.lower()
            if len(low) != len(html):  # lower case of other length: look without it
                low = re.sub(r"[A-Z]", lambda c: c[0].lower(), html)
            end = low.find(f"</{tag}", at)
            body = html[at : end if end >= 0 else len(html)]
            if tag == "style":
                _add_rules(body, rules)
            elif tag in ("textarea", "xmp"):
                node.children.append(unescape(body) if tag == "textarea" else body)
            at = len(html) if end < 0 else (html.find(">", end) + 1 or len(html))
        elif tag not in VOID and not raw.endswith("/"):
            push(node)
    rest = html[at:].partition("<!--")[0]  # what begins there is never closed
    if rest:
        stack[-1].children.append(unescape(rest))
    return root, rules


def _style(node: Node, rules: dict) -> dict[str, str]:
    """The declarations that hold: of sheets by weight, then the element's own, then important ones likewise."""
    a = node.attributes
    if not rules and "style" not in a:
        return {}
    plain, important = {}, {}
    if rules:
        names = [*("." + c for c in set(a.get("class", "").split())), node.tag, "*"] + (["#" + a["id"]] if "id" in a else [])
        memo = rules.setdefault(" ", {})
        for _, _, (some, most) in sorted((r for n in names for r in rules.get(n, ()) if _applies(node, r[1], memo)), key=lambda r: r[0]):
            plain |= some
            important |= most
    if "style" in a:
        some, most = _declarations(a["style"])
        return plain | some | important | most
    return plain | important


def _gone(node: Node, style: dict[str, str]) -> bool:
    """Whether neither the element nor anything in it is shown."""
    return node.tag in NEVER or "hidden" in node.attributes or style.get("display") == "none" or (node.tag == "dialog" and "open" not in node.attributes)


def _content(node: Node) -> list:
    """An element's children that may show: of closed details the first summary."""
    if node.tag != "details" or "open" in node.attributes:
        return node.children
    return next(([c] for c in node.children if isinstance(c, Node) and c.tag == "summary"), [])


class _Lines:
    """Lines under way: words of the current line, spacing that is due before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.margin = False
        self.indent: list[str] = []
        self.mark: str | None = None

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.split("\n")
            self._put(first)
            for line in more:
                self.end(force=True)
                self._put(line)
            return
        words = s.split()
        if not words:
            self.space = self.space or bool(s) and bool(self.now)
            return
        if self.space or s[0] in _SPACE or s[0].isspace():
            if self.now:
                self._put(" ")
        self.space = False
        self._put(" ".join(words))
        self.space = s[-1].isspace()

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.now:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            lead = "".join(self.indent)
            if self.mark is not None:
                lead = lead[: len(lead) - len(self.mark)] + self.mark
                self.mark = None
            self.now.append(lead)
        self.now.append(s)

    def end(self, force: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif force and self.lines and not self.margin:
            self.lines.append("")
        self.space = False


def _holders(table: Node) -> set[int]:
    """Elements of a table (by id()) that have a row or a cell of it inside."""
    out, todo = set(), [(c, ()) for c in table.children if isinstance(c, Node)]
    while todo:
        n, up = todo.pop()
        if n.tag in ("tr", "td", "th"):
            while up and id(up[0]) not in out:
                out.add(id(up[0]))
                up = up[1]
        elif n.tag != "table" and n.tag not in NEVER:
            todo += [(c, (n, up)) for c in n.children if isinstance(c, Node)]
    return out


def _rows(table: Node, rules: dict, visible: bool) -> tuple[list[Node], list[tuple[Node, bool]], list[tuple]]:
    """Captions and visible rows of a table, and what else stands in it, in order; rows of inner tables aren't among them.

    Cells outside a row that follow one another are a row.
    """
    captions, out, stray, holders = [], [], [], _holders(table)
    row: Node | None = None
    todo = [(c, visible) for c in reversed(table.children)]
    while todo:
        n, v = todo.pop()
        if isinstance(n, str):
            stray.append((n, v))
            row = row if not n.strip() else None
            continue
        if n.tag in ("td", "th"):
            if row is None:
                row = Node("tr", {})
                out.append((row, v))
            row.children.append(n)
            continue
        row = None
        style = _style(n, rules)
        if _gone(n, style):
            continue
        v = style.get("visibility", "visible" if v else "hidden") not in ("hidden", "collapse")
        if n.tag == "tr":
            out.append((n, v))
        elif n.tag in ("caption",):
            captions.append(n)
        elif n.tag in ("thead", "tbody", "tfoot", "colgroup") or id(n) in holders:
            if n.tag in BLOCK:  # text around it isn't of one line with its own
                stray.append((Node("div", {}), v))
            todo += [(c, v) for c in reversed(n.children)]
        else:
            stray.append((n, v))
    return captions, out, stray


def _drawn(svg: Node) -> None:
    """Take out what a drawing doesn't show; each of its texts stands for itself."""
    todo = [svg]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in UNDRAWN]
        for c in n.children:
            if isinstance(c, Node):
                if c.tag == "text":
                    c.tag = "div"
                todo.append(c)


def _table(table: Node, rules: dict, visible: bool, done: dict) -> list[str] | None:
    """The lines of a table, an empty one for space; None if it has no row."""
    captions, rows, stray = _rows(table, rules, visible)
    if not any(r for r, _ in rows):
        return None
    lines: list[str] = []
    for shown, run in groupby(stray, key=lambda s: s[1]):  # browsers show it before the table
        lines += _render([c for c, _ in run], rules, shown, done)
    lines.append("")
    lines += [line for c in captions for line in _render(c.children, rules, visible, done) if line]
    return lines + _aligned(rows, rules, done)


def _inner_tables(root: Node, rules: dict) -> dict[int, list[str] | None]:
    """The lines of tables that lie in a table, by id(), made from the innermost on, so that none is laid out within another's making."""
    found, todo = [], [(root, True, False)]
    while todo:
        n, v, within = todo.pop()
        style = _style(n, rules)
        if _gone(n, style):
            continue
        if "visibility" in style:
            v = style["visibility"] not in ("hidden", "collapse")
        if n.tag == "table":
            if within:
                found.append((n, v))
            within = True
        todo += [(c, v, within) for c in _content(n) if isinstance(c, Node)]
    done: dict[int, list[str] | None] = {}
    for n, v in reversed(found):
        done[id(n)] = _table(n, rules, v, done)
    return done


_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def _counted(n: int, kind: str) -> str:
    """A list item's number as its list writes it."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for size, mark in _ROMAN:
            out += mark * (n // size)
            n %= size
        return out.upper() if kind == "I" else out
    return str(n)


def _number(a: dict[str, str], name: str) -> int | None:
    m = re.match(r"\s*(-?\d{1,8})\b", a.get(name, ""))
    return int(m[1]) if m else None


def _render(children: list, rules: dict, visible: bool, done: dict) -> list[str]:
    w = _Lines()
    lists: list[list] = []
    pre = 0
    todo: list = [(c, visible) for c in reversed(children)]
    while todo:
        item, v = todo.pop()
        if isinstance(item, str):
            if v:
                w.text(item, pre > 0)
            continue
        if isinstance(item, tuple):  # the end of an element
            tag, indents, was_pre, was_list = item
            if tag in BLOCK:
                w.end()
                w.margin = w.margin or (tag in MARGIN and not (was_list and len(lists) > 1))
            del w.indent[len(w.indent) - indents :]
            if tag == "li":
                w.mark = None
            pre -= was_pre
            if was_list:
                lists.pop()
            continue
        tag, a = item.tag, item.attributes
        style = _style(item, rules)
        if _gone(item, style) or tag == "input":
            continue
        if "visibility" in style:
            v = style["visibility"] not in ("hidden", "collapse")
        if tag == "br":
            if v:
                w.end(force=True)
            continue
        if tag == "svg":
            _drawn(item)
        if tag == "table":
            lines = done.pop(id(item)) if id(item) in done else _table(item, rules, v, done)
            if lines is not None:
                w.end()
                w.margin = True
                for line in lines:
                    w.margin = w.margin or not line
                    w.text(line, True)
                    w.end()
                w.margin = True
                continue
        if tag in BLOCK:
            w.end()
            w.margin = w.margin or (tag in MARGIN and not (tag in ("ul", "ol") and lists))
        indents = 0
        if tag in ("ul", "ol", "menu", "dir"):
            start, step = _number(a, "start"), -1 if "reversed" in a else 1
            if start is None:
                start = sum(isinstance(c, Node) and c.tag == "li" for c in item.children) if step < 0 else 1
            lists.append([tag == "ol", start, step, a.get("type", "")])
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0]:
                now = _number(a, "value")
                now = lists[-1][1] if now is None else now
                mark = f"{_counted(now, lists[-1][3])}. "
                lists[-1][1] = now + lists[-1][2]
            w.indent.append(" " * len(mark))
            w.mark, indents = mark, 1
        elif tag in ("blockquote", "dd"):
            w.indent.append("  ")
            indents = 1
        is_pre = tag in ("pre", "xmp", "textarea")
        pre += is_pre
        todo.append(((tag, indents, is_pre, tag in ("ul", "ol", "menu", "dir")), v))
        todo += [(c, v) for c in reversed(_content(item))]
    w.end()
    return w.lines


def _aligned(rows: list[tuple[Node, bool]], rules: dict, done: dict) -> list[str]:
    """Each row one line, its cells padded to the widest of their column; a cell's own lines are joined."""
    grid = []
    held: dict[int, int] = {}  # column -> rows for which a cell from above still fills it
    for row, v in rows:
        cells: list[str] = []
        for c in row.children:
            while isinstance(c, Node) and held.get(len(cells), 0):
                held[len(cells)] -= 1
                cells.append("")
            if not isinstance(c, Node):
                if v and c.strip():
                    cells.append(" ".join(c.split()))
                continue
            style = _style(c, rules)
            if _gone(c, style):
                continue
            shown = style.get("visibility", "visible" if v else "hidden") not in ("hidden", "collapse")
            inner = c.children if c.tag in ("td", "th") else [c]
            cells.append(" ".join(" ".join(_render(inner, rules, shown, done)).split()))
            across, down = (int(n) if n.isdecimal() and n.isascii() and len(n) < 6 else 1 for n in (c.attributes.get("colspan", ""), c.attributes.get("rowspan", "")))
            across = max(1, min(across, 1000))  # as the language has it
            if down > 1:
                held.update(dict.fromkeys(range(len(cells) - 1, len(cells) - 1 + across), min(down, 65534) - 1))
            cells += [""] * (across - 1)
        for k in [k for k in held if k >= len(cells)]:
            held[k] = max(0, held[k] - 1)
        grid.append(cells)
    widths = [0] * max(map(len, grid), default=0)
    for cells in grid:
        for i, c in enumerate(cells):
            widths[i] = max(widths[i], len(c))
    lines = ["  ".join(c.ljust(n) for c, n in zip(cells, widths, strict=False)).rstrip() for cells in grid]
    return [line for line in lines if line]


def extract(html: str | None) -> str:
    """All visible text of a page, laid out."""
    if not html:
        return ""
    root, rules = parse(html.replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join(_render(root.children, rules, True, _inner_tables(root, rules))).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id`` and ``text`` of each page.  One narrow pass."""
    tune(pages.sparkSession)
    picked = select(pages, page_id=id_col, html=html_col)

    def work(batches):
        for b in batches:
            (raw,) = columns(b, "html")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(h) for h in raw], pa.string())], names=["page_id", "text"])

    return picked.mapInArrow(work, f"page_id {picked.schema['page_id'].dataType.simpleString()}, text string")
