"""Secret scan: base patterns and an assignment-aware lexer.

The lexer reads source and configuration syntax into name-literal pairs: ``name = literal``,
``"name": literal``, ``name := literal``, ``name => literal``, ``export NAME=literal``, block scalars
(``name: |``), triple quotes, words alone on a line of configuration, names given beside their values
(``key="ApiKey" value="..."``, ``name: KEY`` over ``value: ...``), values below their names
(``{"token": {"value": ...}}``), elements (``<password>...</password>``), calls (``setToken("...")``,
``set("token", "...")``) and addresses with a password.  It propagates constants through uses before
and after them (``b = a``, ``"x" + a``, ``"${a}"``) and scores each literal by how sensitive the name
is that it reaches and by how random it looks.

A constant is put in where it is used while the value has at most ``LONGEST`` characters; beyond that its use is an
unknown name, so values that grow by themselves cost no more than others.  A value without quotes ends at a blank or
bracket; in a run of more than ``LONGEST`` characters without any it ends at the next operator as well, so that each
character of such a run is of one value and not of all before it.

Defined results: a null or empty text has no span; offsets are in code points, end exclusive;
repeated rows are scanned each by itself; a null id is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, select, tune

#: Characters of a value up to which constants are put in.
LONGEST = 4096
#: The kinds in the order of a report; the first three are base patterns.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
# A run of at least 16: a shorter run can hold no match, so this finds the maximal long runs.
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("password", "passwd", "secret", "token", "api")

_OPERATOR = re.compile(r":=|=>|[=:]")
_STEP = re.compile(r":=|=>|[=:{}]")
# Read backwards from the operator: blanks, the end of a quoted or bracketed name, the name.
_NAME = re.compile(r"""[ \t]*["']?(?:\]["']?)?([\w$.\-]+)""", re.ASCII)
_NAME_START = re.compile(r"[A-Za-z_$]", re.ASCII)
_QUOTED = re.compile(
    r"""[ \t]*(?:[fFrRbBuU]{1,2}(?=["'])|[@$](?="))?"""
    r"""(?:\"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}"""
    r"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)"""
)
_BLOCK = re.compile(r"[ \t]*[|>][+\-\d]{0,2}[ \t]*\n")
_LINE = re.compile(r"([ \t]*)[^\n]*\n?")
_INDENT = re.compile(r"[ \t]*(?:-[ \t]+)?")
_REST = re.compile(r"[ \t]*(?:\n|\Z)")
_PLAIN = re.compile(r"[ \t]*([A-Za-z]{8,64})[ \t]*(?:\n|\Z)")
_LEAD = re.compile(r"""[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+)?["']?([\w.\-]+)["']?[ \t]*""", re.ASCII)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>\s*+([^<>\s]++)\s*+</", re.ASCII)
_CALL = re.compile(r"""(?<![\w$])([A-Za-z_$][\w$]*+)\(\s*+(?:"([^"\\\n]*+)"|'([^'\\\n]*+)')\s*+(?:,\s*+(?:"([^"\\\n]*+)"|'([^'\\\n]*+)')\s*+)?\)""", re.ASCII)
_GIVES = re.compile(r"(?:set|with|use|put|add|assign|update|define|configure)(?=[A-Z_]|$)|[A-Z][a-z]", re.ASCII)
_ADDRESS = re.compile(r"://[^\s:/@\"'<>]*+:([^\s/@\"'<>]++)@")
_GAP = re.compile(r"[ \t]*")
_RUN = re.compile(r"""[^\s"'`,;#(){}\[\]<>+]+""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)(?=[ \t]*[\"'`\w$])")
_REFERENCE = re.compile(r"\$\{([A-Za-z_][\w.\-]*)\}|\$([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\}", re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.ASCII)

#: How strongly a part of a name speaks for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.6,
    "access": 0.4, "key": 0.6, "api": 0.4, "client": 0.2, "signing": 0.5, "encryption": 0.5, "session": 0.4, "salt": 0.5,
}
#: A name that ends so speaks of a secret without being one.
DESCRIBING = frozenset("url uri path file filename dir folder name names id ids type count length size limit field column label hint policy prefix suffix endpoint expiry expires ttl algorithm version format header class status max min index schema title description".split())
#: Before ``key``, a key that is no secret.
KEY_KINDS = frozenset("primary foreign public sort partition cache row unique composite shortcut hot map group join index natural surrogate candidate".split())
#: Names of a value whose meaning is said beside or above it, and names of that name.
VALUES = frozenset("value val default data content text plain raw current plaintext".split())
LABELS = frozenset("name key id variable property".split())
#: Words alone on a line of configuration that are no password.
COMMON = frozenset("required optional undefined disabled enabled password passwords redacted encrypted plaintext username changeme mandatory".split())
#: Literals that stand for a secret to be filled in.
PLACEHOLDERS = re.compile(r"(?i)\A(?:change_?me|example|sample|your[_-].*|x+|\*+|none|null|true|false|undefined|todo|test|<.*>|[$%{].*)\Z")


#: A value that is only an address, or words and a number joined by signs.
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*+://")
_JOINED = re.compile(r"[a-z]++(?:[_\-][a-z]++)+(?:[_\-]?\d{1,4})?")


def name_score(name: str) -> float:
    """0 to 1: the summed weight of the name's parts, at most 1; 0 where it speaks of a secret without being one."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in DESCRIBING or (len(words) > 1 and words[-1] in ("key", "keys") and words[-2] in KEY_KINDS):
        return 0.0
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in set(words)))


def literal_score(value: str) -> float:
    """0 to 1: length and character entropy; 0 for short, plain or placeholder values and addresses, less for joined words."""
    value = _REFERENCE.sub("", value)  # what stays of names without a known value
    n = len(value)
    if n < 8 or " " in value or PLACEHOLDERS.match(value) or _URL.match(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, entropy / 3.5) * (0.55 + 0.15 * min(3, kinds)) * (0.6 if _JOINED.fullmatch(value) else 1.0)


def base_spans(text: str) -> Iterator[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the base patterns."""
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                yield "assign", m.start(), m.end(), m.start(1)
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end(), m.start()


def _name_before(text: str, end: int) -> str | None:
    """The name that stands before a place of the text, whatever its length."""
    width = 128
    while True:
        left = max(0, end - width)
        found = _NAME.match(text[left:end][::-1])
        if left and (found.end() == end - left if found else not text[left:end].strip(" \t\"']")):
            width *= 2  # it may go on before
            continue
        if not found:
            return None
        name = found[1][::-1]
        first = _NAME_START.search(name)
        return name[first.start() :] if first else None


Pair = tuple[str, str, list[tuple[int, int]]]


class _Scopes:
    """Names above a place: of the braces that are open there and of the lines that it is indented below."""

    def __init__(self, text: str):
        self.text, self.seen, self.line, self.indent = text, 0, 0, None
        self.braces: list[str | None] = []
        self.lines: list[tuple[int, str]] = []
        self.label: tuple[str, int, int] | None = None  # a name given as a value, how deep, for how many more pairs
        self.last: tuple[int, str] = (-1, "")  # end and name of the last operator

    def at(self, place: int) -> None:
        """Go on to a place of the text."""
        if (nl := self.text.rfind("\n", self.seen, place)) >= 0:
            self.line, self.indent = nl + 1, None
        self.seen = max(self.seen, place)
        if self.indent is None:
            self.indent = _INDENT.match(self.text, self.line).end() - self.line
            while self.lines and self.lines[-1][0] >= self.indent:
                self.lines.pop()

    def brace(self, place: int) -> None:
        if self.text[place] == "}":
            if self.braces:
                self.braces.pop()
        else:
            own = self.last[0] >= 0 and _GAP.match(self.text, self.last[0]).end() == place
            self.braces.append(self.last[1] if own else None)
            self.last = (-1, "")
        self.label = None

    def full(self, name: str) -> str:
        """The name, or where it only says that this is a value, the one that says of what."""
        if name.lower() not in VALUES:
            return name
        if self.label and self.label[1] == len(self.braces):
            return self.label[0]
        above = self.braces[-1] if self.braces else self.lines[-1][1] if self.lines else None
        return above or name

    def took(self, name: str, value: str) -> None:
        if name.rpartition(".")[2].lower() in LABELS and len(value) <= 128 and _LEAD.fullmatch(value):
            self.label = (value, len(self.braces), 3)
        elif self.label:
            self.label = (*self.label[:2], self.label[2] - 1) if self.label[2] > 1 else None


def _block(text: str, pos: int, indent: int) -> tuple[list[tuple[int, int]], int]:
    """Places of the lines that are indented further, and where they end."""
    places = []
    while pos < len(text):
        line = _LINE.match(text, pos)
        body = text[line.end(1) : line.end()].rstrip()
        if body and line.end(1) - pos <= indent:
            break
        if body:
            places.append((line.end(1), line.end(1) + len(body)))
        pos = line.end()
    return places, pos


def _assigned(text: str) -> Iterator[Pair]:
    """Pairs of operators, constants put in where they are used, before or after they are known."""
    known: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    waiting: dict[str, dict[str, None]] = {}
    scopes = _Scopes(text)
    at, run, block_end = 0, (0, 0), 0  # run: the last run of characters without quotes

    def found(name: str, value: str, places: list[tuple[int, int]]) -> Iterator[Pair]:
        todo = [name]
        while todo:
            one = todo.pop()
            known[one] = (value, places)
            yield one, value, places
            if len(value) <= LONGEST:
                todo += waiting.pop(one, ())

    for op in _STEP.finditer(text):
        if op.start() < at:
            continue
        if op[0] in "{}":
            if text[op.start() - 1 : op.start()] != "$":
                scopes.brace(op.start())
            continue
        if text[op.end() : op.end() + 1] in ("=", "/") or text[op.start() - 1 : op.start()] in ("!", "<", ">", "="):
            continue
        name = _name_before(text, op.start())
        if not name:
            continue
        scopes.at(op.start())
        plain, name = name, scopes.full(name)
        scopes.last = (op.end(), name)
        if op[0] == ":" and op.start() >= block_end and (head := _BLOCK.match(text, op.end())):
            places, block_end = _block(text, head.end(), scopes.indent)
            if places:
                yield from found(name, "".join(text[a:b] for a, b in places), places)
            continue
        if op[0] == ":" and _REST.match(text, op.end()):
            scopes.lines.append((scopes.indent, name))
            continue
        value, places, pos, quoted, alias = "", {}, op.end(), False, None
        while True:
            if term := _QUOTED.match(text, pos):
                k = term.lastindex
                start, end, stop, quoted = term.start(k), term.end(k), term.end(), True
            else:
                start = _GAP.match(text, pos).end()
                if not run[0] <= start < run[1]:
                    if not (match := _RUN.match(text, start)):
                        break
                    run = match.span()
                end, quoted = run[1], False
                if places and _OPERATOR.search(text, start, end):  # behind a plus: the next assignment
                    break
                if end - start > LONGEST and (inner := _OPERATOR.search(text, start, end)):
                    end = inner.start()
                    if end == start:
                        break
                stop = end
            part = text[start:end]
            if not quoted and part in known:
                if len(value) + len(known[part][0]) <= LONGEST:
                    value += known[part][0]
                    places.update(dict.fromkeys(known[part][1]))
            elif part and (quoted or not part.isalpha()):  # a bare word of letters is a name or a keyword
                refs = [r for r in _REFERENCE.finditer(part) if (r[1] or r[2] or r[3]) in known] if "{" in part or "$" in part else []
                for r in reversed(refs):
                    put = known[r[1] or r[2] or r[3]]
                    if len(part) + len(put[0]) > LONGEST:
                        continue
                    part = part[: r.start()] + put[0] + part[r.end() :]
                    places.update(dict.fromkeys(put[1]))
                value += part
                if not refs:
                    places[start, end] = None
            if not quoted and pos == op.end() and part not in known and len(part) <= 128 and _NAME_START.match(part):
                alias = part
            pos = stop
            if not (plus := _PLUS.match(text, pos)):
                break
            pos, alias = plus.end(), None
        if alias and alias != name:  # a name that may be given its value later
            waiting.setdefault(alias, {})[name] = None
        if not places and op[0] in ":=" and (word := _PLAIN.match(text, op.end())):
            lead = _LEAD.match(text, scopes.line, op.start())
            # Only a strong name, alone with the word on its line.
            if lead and lead.end() == op.start() and name_score(name) >= 0.9 and word[1].lower() not in COMMON and not name_score(word[1]):
                value, places = word[1], {word.span(1): None}
                pos = word.end(1)
        if places:
            at = pos if text[pos - 1 : pos] in "\"'`" else op.end()
            scopes.took(plain, value)
            yield from found(name, value, list(places))


def _written_out(text: str) -> Iterator[Pair]:
    """Pairs of elements, of calls that set something, and passwords within addresses."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield m[1], m[2], [m.span(2)]
    if "(" in text:
        for m in _CALL.finditer(text):
            first, second = (2 if m[2] is not None else 3), (4 if m[4] is not None else 5 if m[5] is not None else 0)
            if second:
                yield m[first], m[second], [m.span(second)]
            elif _GIVES.match(m[1]):
                yield m[1], m[first], [m.span(first)]
    if "://" in text:
        for m in _ADDRESS.finditer(text):
            yield "password", m[1], [m.span(1)]


def pairs(text: str) -> Iterator[Pair]:
    """(name, value, places of the value's literals) of each pair."""
    if "=" in text or ":" in text:
        yield from _assigned(text)
    yield from _written_out(text)


def scan(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, int, float]]:
    """(kind, start, end, start of the secret, score), by start and then kind as in KINDS."""
    if not text:
        return []
    found = [(*s, 1.0) for s in base_spans(text)]
    best: dict[tuple[int, int], float] = {}
    known: dict[str, float] = {}  # one value may reach many names
    for name, value, places in pairs(text):
        if not (n := name_score(name)):
            continue
        if value not in known:
            known[value] = literal_score(value)
        if (score := n * known[value]) >= threshold:
            for p in places:
                best[p] = max(score, best.get(p, 0.0))
    found += [("literal", a, b, a, s) for (a, b), s in best.items()]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = "struct<kind:string,start:bigint,end:bigint,secret_start:bigint,score:double>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end, secret_start, score) of each row.  One narrow pass."""
    tune(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_start", pa.int64()), ("score", pa.float64())]))

    def work(batches):
        for b in batches:
            (texts,) = columns(b, "text")
            spans = [[dict(zip(("kind", "start", "end", "secret_start", "score"), s, strict=True)) for s in scan(t, threshold)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, type=span)], names=["doc_id", "spans"])

    picked = select(docs, doc_id=id_col, text=text_col)
    return picked.mapInArrow(work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def redact_text(text: str | None, mark: str = "[SECRET]", threshold: float = 0.5) -> str | None:
    """The text with every secret replaced; of an assignment only the value goes."""
    out, at = [], 0
    for _, _, end, start, _ in sorted(scan(text, threshold), key=lambda s: s[3]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return text if not at else "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in the text; a row without a secret stays as it is."""
    tune(docs.sparkSession)
    i = docs.columns.index(text_col)
    k = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def work(batches):
        for b in batches:
            old = b.column(i).to_pylist()
            new = [redact_text(t) for t in old]
            cols = list(b.columns)
            cols[i] = pa.array(new, type=b.schema.field(i).type)
            if k is not None:
                n = b.column(k).to_pylist()
                cols[k] = pa.array([x if a == c else len(c) for a, c, x in zip(old, new, n, strict=True)], type=b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(work, docs.schema)
