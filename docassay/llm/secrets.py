"""Secrets by assignment-aware lexing.

A text is read, whatever language it is in, as a stream of tokens: strings (escaped, triple-quoted or in backticks),
line and block comments, brackets, line ends, section heads, tags, and assignment operators (= := => : and their
like). An operator pairs the name before it (dotted, quoted, or an index as in config["password"]) with the literal
behind it: a string, strings that are put together, or a bare value up to the end of the value; so do #define and the
call of a setter. A name is sensitive by its words (snake, dotted or camel case), not by what is in them. Names carry the names around them: keys of JSON and
of indented YAML, tables in brackets, and elements and attributes of XML. A bare value that is itself a name stands
for that name's literals, wherever in the text it is defined, so constants propagate to a fixed point. A literal's
score is the weight of the most sensitive name that it reaches, times how random it looks; from THRESHOLD on it is a
span of kind literal. Base spans always stay, and a literal within one is not added.

Edge cases: a null text is an empty one, without spans; unclosed strings end with their line, unclosed triple quotes are
passed over; comments are read like other text; every pattern and sweep takes time in proportion to the text (and sorting), however
long it or its names are; repeated rows give repeated results; an empty table gives an empty one. `spans` replaces a
column of that name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, _parse_datatype_string

from .common import append

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Weights of words in names; least score that makes a literal a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "private": 0.7, "auth": 0.7, "key": 0.6}
THRESHOLD = 0.45

#: The tokens, the first that fits. A quote behind a letter or digit is an apostrophe.
TOKEN = re.compile(
    r"""(?P<triple>(?:\"{3}|'{3}))
    |(?<![\w])(?P<string>"(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+'|`(?:[^`\\\n]|\\[^\n])*+`)
    |(?P<block>/\*|<!--)
    |(?P<define>(?<!\S)\#[ \t]*+define[ \t]++(?P<constant>\w++)(?=[ \t]))
    |(?P<comment>(?<!\S)(?:\#|//|--[ ]))
    |(?P<end>\n[ \t]*+)
    |(?P<tag></?+[A-Za-z_][\w.:-]*+)
    |(?P<op>:=|=>|\?=|\+=|(?<![=!<>])=(?!=)|:(?!:|//))
    |(?P<open>[{(\[])
    |(?P<close>[})\]])""",
    re.X,
)
#: A type between a name and its value, a bare value, and the head of a section.
TYPE = re.compile(r"[ \t]*+[\w.\[\]<>|]++[ \t]*+(?==[^=])")
BARE = re.compile(r"[ \t]*+([^\s\"'`,;{}()\[\]<>]++)")
SECTION = re.compile(r"\[[ \t]*+([^\[\]\n\"']++)\][ \t]*+(?=\n|\Z)")


#: Words of a name: in snake, dotted or camel case.
PARTS = re.compile(r"[A-Z]++(?![a-z])|[A-Z]?[^\W\dA-Z_]++|[A-Z]")
#: What those names begin with whose calls set what they name; signs between strings that make one.
SETTERS, JOINS = ("set", "with"), ("+", ".", "..", "&", "\\", "")


def weight(name: str) -> float:
    """That of the most sensitive word, or of two words written as one: `api_key`, `dbPassword`, `authtoken`, but not `keyboard` or `author`."""
    words = [w.lower() for w in PARTS.findall(name)]
    words += [a + b for a, b in zip(words, words[1:])]
    best = 0.0
    for w in words:
        w = w.removesuffix("s")
        best = max(best, SENSITIVE.get(w, 0.0), *(x for s, x in SENSITIVE.items() if x >= 0.9 and w.endswith(s)), 0.0)
    return best


def randomness(literal: str) -> float:
    """From 0 to 1: entropy of the characters, less for words and short literals."""
    n = len(literal)
    if n < 8 or any(c.isspace() for c in literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.isdigit, str.islower, str.isupper))
    return min(1.0, entropy / 3.5) * min(1.0, n / 12) * (1.0 if kinds > 1 else 0.6)


class Lexer:
    """Reads a text into pairs (name, weight of the names around it, literal's start and end, whether it is a bare value)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.pairs: list[tuple[str, float, int, int, bool]] = []
        self.string: tuple[int, int] | None = None  # the last string of this line, with its quotes
        self.indexed = False  # the last string stood in square brackets
        self.section = 0.0
        self.outer: list[tuple[float, str]] = []  # weights and bracket of what is open
        self.keys: list[tuple[int, float]] = []  # indents and weights of keys above, by indent
        self.indent = 0
        self.pending: tuple[int, float] | None = None  # a key without value yet: its indent and weight
        self.parts: dict[tuple[int, int], list[tuple[int, int]]] = {}  # strings that are put together, by the first
        self.ahead: dict[str, int] = {}

    def around(self) -> float:
        return max(self.section, self.outer[-1][0] if self.outer else 0.0, self.keys[-1][1] if self.keys else 0.0)

    def find(self, sign: str, at: int) -> int:
        """Like str.find; places that come later in the text are looked up once."""
        known = self.ahead.get(sign, -2)
        if known == -1 or known >= at:
            return known
        self.ahead[sign] = self.text.find(sign, at)
        return self.ahead[sign]

    def name_before(self, at: int) -> str:
        text, s = self.text, self.string
        if s:
            gap = text[s[1] : at].strip(" \t")
            if gap == "" or (gap == "]" and self.indexed):
                return text[s[0] + 1 : s[1] - 1]
            self.string = None  # no later operator is nearer
        end = at
        while end and text[end - 1] in " \t?!+":
            end -= 1
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.$-"):
            start -= 1
        return text[start:end]

    def paired(self, name: str, start: int, end: int, bare: bool) -> None:
        if name and start < end:
            self.pairs.append((name, self.around(), start, end, bare))

    def read(self) -> Lexer:
        text, n = self.text, len(self.text)
        at, name, awaiting = 0, "", -1  # awaiting: where the value of `name` may begin
        quoted = False  # only a string is such a value
        last: tuple[str, int, int, int] | None = None  # the last string that was paired: name, the first of its parts, its end behind the quote
        if head := SECTION.match(text):
            self.section = weight(head.group(1))
        while m := TOKEN.search(text, at):
            kind, start, at = m.lastgroup, m.start(), m.end()
            if awaiting >= 0 and text[awaiting:start].strip(" \t\r\\"):  # something stands before this token: a bare value
                b = None if quoted else BARE.match(text, awaiting)
                if b:
                    self.paired(name, *b.span(1), True)
                awaiting = -1
                if b and b.end() > start:
                    at = b.end()
                    continue
            if kind == "triple" or kind == "string":
                if kind == "triple":
                    close = self.find(m.group(), at)
                    if close < 0:
                        continue
                    inner, at = (at, close), close + 3
                else:
                    inner = (start + 1, at - 1)
                if awaiting >= 0:
                    self.paired(name, *inner, False)
                    last = (name, *inner, at)
                    awaiting = -1
                elif last and (gap := text[last[3] : start]).strip() in JOINS and (gap.strip() or "\n" not in gap or self.outer[-1:] and self.outer[-1][1] == "("):
                    self.paired(last[0], *inner, False)
                    self.parts.setdefault(last[1:3], [last[1:3]]).append(inner)
                    last = (*last[:3], at)
                else:
                    last = None
                self.string = (inner[0] - 1, inner[1] + 1) if kind == "string" else None
                self.indexed = text[max(start - 1, 0) : start] == "["
            elif kind == "define":
                name, awaiting, quoted = m.group("constant"), at, False
            elif kind == "block" or kind == "comment":
                awaiting = -1
            elif kind == "end":
                if awaiting >= 0 and text[start - 1] == "\\":
                    awaiting = at
                    continue
                awaiting, self.string = -1, None
                if text[at : at + 1] not in ("", "\n", "#"):
                    self.indent = at - start - 1
                    if self.pending and self.indent > self.pending[0]:
                        self.keys.append(self.pending)
                    while self.keys and self.keys[-1][0] >= self.indent:
                        self.keys.pop()
                    self.pending = None
                    if not self.outer and (head := SECTION.match(text, at)):
                        self.section, at = weight(head.group(1)), head.end()
            elif kind == "tag":
                if m.group()[1] != "/" and self.find(">", at) == at:
                    end = self.find("<", at)
                    if end > at + 1 and not text[at + 1 : end].isspace():
                        inner = text[at + 1 : end]
                        self.paired(m.group()[1:], at + 1 + len(inner) - len(inner.lstrip()), at + 1 + len(inner.rstrip()), False)
                        at = end
            elif kind == "op":
                name, quoted = self.name_before(start), False
                if m.group() == ":" and (t := TYPE.match(text, at)):
                    if text[t.end() : t.end() + 1] == "=":  # a type before the value, as in name: str = "x", or a second name
                        name = max(name, t.group().strip(), key=weight)
                        at = awaiting = t.end() + 1
                        continue
                awaiting = at if name else -1
                self.pending = (self.indent, max(weight(name), self.around())) if m.group() == ":" and name else None
            elif kind == "open":
                held = weight(name) if awaiting >= 0 else 0.0
                self.outer.append((max(held, self.outer[-1][0] if self.outer else 0.0) if m.group() == "{" else 0.0, m.group()))
                awaiting = -1
                if m.group() == "(":
                    called = self.name_before(start).rpartition(".")[2]
                    if (words := PARTS.findall(called)) and words[0].lower() in SETTERS:
                        name, awaiting, quoted = called, at, True
            elif kind == "close":
                awaiting = -1
                if self.outer:
                    self.outer.pop()
        if awaiting >= 0 and not quoted and (b := BARE.match(text, awaiting)):
            self.paired(name, *b.span(1), True)
        return self


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach sensitive names."""
    read = Lexer(text).read()
    pairs = read.pairs
    defined: dict[str, list[tuple[int, int]]] = {}
    best: dict[tuple[int, int], float] = {}
    for name, around, a, b, _ in pairs:
        best[a, b] = max(best.get((a, b), 0.0), weight(name), around)
        defined.setdefault(name, []).append((a, b))
    # A value that is a defined name gets its pair's weight, heaviest first, and hands it to what it is defined as.
    uses: dict[str, list[str]] = {}
    todo: list[tuple[float, str]] = []
    for name, _, a, b, bare in pairs:
        value = text[a:b] if bare else ""
        if value in defined and value != name:
            uses.setdefault(name, []).append(value)
            todo.append((best[a, b], value))
    done: set[str] = set()
    for heaviest, start in sorted(todo, reverse=True):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in done:
                done.add(x)
                stack += uses.get(x, [])
                for s in defined[x]:
                    best[s] = max(best[s], heaviest)
    constants = {(a, b) for name, _, a, b, bare in pairs if bare and text[a:b] in defined}
    later = {s for parts in read.parts.values() for s in parts[1:]}
    found = []
    for s, w in best.items():
        parts = read.parts.get(s, [s])
        if w and s not in constants and s not in later and w * randomness("".join(text[a:b] for a, b in parts)) >= THRESHOLD:
            found += parts
    return found


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), True) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), True) for m in HEX.finditer(text)]
    starts, ends, furthest = [], [], -1
    for a, _, b, _ in sorted(found):
        furthest = max(furthest, b)
        starts.append(a)
        ends.append(furthest)
    added = []
    for a, b in literals(text):
        k = bisect_right(starts, a)
        if not k or ends[k - 1] < b:
            added.append((a, 3, b, False))
    return sorted(found + added)


def find(docs: DataFrame) -> DataFrame:
    """Adds `spans`: kind, start and end in code points, and whether it is a base span."""
    kind = _parse_datatype_string("array<struct<kind:string,start:int,end:int,base:boolean>>")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        names = ("kind", "start", "end", "base")
        made = [[dict(zip(names, (KINDS[k], a, b, sure), strict=True)) for a, k, b, sure in spans(t.as_py() or "")] for t in batch.column("text")]
        return [pa.array(made, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))]

    return append(docs, [StructField("spans", kind)], run)
