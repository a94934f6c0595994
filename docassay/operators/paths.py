"""Paths over a document's nodes: parsed on the driver, turned into column expressions within the document's row.

A path has steps with / and // (elements, *, ., .., @attribute, text(), self::element), predicates on any step
(places, paths, comparisons, and, or, not(), contains(), starts-with(), count(), position(), last()), filter
expressions like (a | b)[1]/c, unions and calls of functions. What isn't of this language raises ValueError, so that
no path silently finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""\s*(?: (?P<text>"[^"]*"|'[^']*') | (?P<number>\d+) | (?P<name>(?:\{[^}]*\})?[^\W\d][\w.-]*(?::(?!:)[^\W\d][\w.-]*)?) | (?P<sign>//|::|\.\.|!=|<=|>=|[/|()\[\],@=*.<>]) )""",
    re.X,
)
AXES = {"child": "", "self": "self::", "attribute": "@"}
XML = "http://www.w3.org/XML/1998/namespace"


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Number:
    value: int


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple


@dataclass(frozen=True)
class Op:
    sign: str
    left: object
    right: object


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Filter:
    base: object
    predicates: tuple


@dataclass(frozen=True)
class Step:
    """sep is / or //; test an element, *, ., .., @name, @*, text() or self::element."""

    sep: str
    test: str
    predicates: tuple = ()

    @property
    def is_element(self) -> bool:
        return self.test == "*" or self.test[0] not in ".@" and self.test != "text()" and "::" not in self.test


@dataclass(frozen=True)
class Path:
    """Steps from the nodes of base; without base from the root (absolute) or from the node at hand."""

    base: object
    absolute: bool
    steps: tuple


class _Parser:
    def __init__(self, source: str) -> None:
        self.source, self.tokens, self.at = source, [], 0
        at, end = 0, len(source.rstrip())
        while at < end:
            m = _TOKEN.match(source, at)
            if not m:
                self.wrong()
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()

    def wrong(self) -> None:
        raise ValueError(f"not a path that can be read: {self.source!r}")

    def peek(self, ahead: int = 0) -> tuple[str | None, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, "")

    def is_next(self, *said: str) -> bool:
        kind, s = self.peek()
        return kind in ("sign", "name") and s in said

    def take(self, *said: str) -> str:
        if said and not self.is_next(*said) or not self.peek()[0]:
            self.wrong()
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        made = self.either()
        if self.peek()[0]:
            self.wrong()
        return made

    def chain(self, below: Callable, *signs: str):
        made = below()
        while self.is_next(*signs):
            made = Op(self.take(), made, below())
        return made

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.compared, "and")

    def compared(self):
        return self.chain(self.union, "=", "!=", "<", ">", "<=", ">=")

    def union(self):
        parts = [self.path()]
        while self.is_next("|"):
            self.take()
            parts.append(self.path())
        return parts[0] if len(parts) == 1 else Union(tuple(parts))

    def path(self):
        kind, said = self.peek()
        called = kind == "name" and self.peek(1)[1] == "(" and said != "text"
        if kind not in ("text", "number") and said != "(" and not called:
            return self.steps(None)
        base = self.primary()
        tests = self.predicates()
        base = Filter(base, tests) if tests else base
        return self.steps(base) if self.is_next("/", "//") else base

    def primary(self):
        kind, said = self.peek()
        if kind == "text":
            return Text(self.take()[1:-1])
        if kind == "number":
            return Number(int(self.take()))
        if said == "(":
            self.take()
            made = self.either()
            self.take(")")
            return made
        name, arguments = self.take(), []
        self.take("(")
        while not self.is_next(")"):
            arguments.append(self.either())
            if not self.is_next(")"):
                self.take(",")
        self.take(")")
        return Call(name, tuple(arguments))

    def steps(self, base) -> Path:
        absolute = base is None and self.is_next("/", "//")
        made, sep = [], self.take() if base is not None or absolute else "/"
        while True:
            made.append(self.step(sep))
            if not self.is_next("/", "//"):
                return Path(base, absolute, tuple(made))
            sep = self.take()

    def step(self, sep: str) -> Step:
        kind, said = self.peek()
        if self.is_next(".", ".."):
            test = self.take()
        elif self.is_next("@"):
            self.take()
            test = "@" + self.name()
        elif kind == "name" and self.peek(1)[1] == "::":
            test = AXES.get(self.take(), "")
            if said not in AXES:
                self.wrong()
            self.take("::")
            test += self.name()
        elif said == "text" and self.peek(1)[1] == "(":
            self.take()
            self.take("(")
            self.take(")")
            test = "text()"
        else:
            test = self.name()
        made = Step(sep, test, self.predicates())
        if made.is_element and ":" in test:
            self.wrong()  # elements have lost their namespaces
        return made

    def name(self) -> str:
        if not self.is_next("*") and self.peek()[0] != "name":
            self.wrong()
        return self.take()

    def predicates(self) -> tuple:
        made = []
        while self.is_next("["):
            self.take()
            made.append(self.either())
            self.take("]")
        return tuple(made)


def parse(source: str):
    """The syntax tree of a path."""
    return _Parser(source).whole()


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def nodes() -> Column:
    return F.col("nodes")


def below(node: Column) -> Column:
    """A node's descendants, which follow it; none of a null node."""
    return F.slice(nodes(), F.coalesce(node["node"] + 2, F.lit(1)), F.coalesce(node["last"] - node["node"], F.lit(0)))


def raw(node: Column) -> Column:
    """A node's text."""
    return F.substring(F.col("content"), node["start"] + 1, node["end"] - node["start"])


def without_nulls(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def nonempty(xs: Column) -> Column:
    return F.filter(xs, lambda x: x != "")


def pieces(node: Column, every: bool = False) -> Column:
    """Texts of a node between its children or, with every, between all starts and ends of its descendants."""
    inside = below(node) if every else F.filter(below(node), lambda n: n["parent"] == node["node"])
    if every:
        marks = F.concat(F.transform(inside, lambda n: n["start"]), F.transform(inside, lambda n: n["end"]))
        bounds = F.sort_array(F.array_distinct(F.concat(F.array(node["start"], node["end"]), marks)))
        spans = F.zip_with(F.slice(bounds, F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(0))), F.slice(bounds, F.lit(2), F.size(bounds)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    else:
        spans = F.zip_with(F.concat(F.array(node["start"]), F.transform(inside, lambda n: n["end"])), F.concat(F.transform(inside, lambda n: n["start"]), F.array(node["end"])), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return nonempty(F.transform(spans, lambda s: F.substring(F.col("content"), s["a"] + 1, s["b"] - s["a"])))


def in_order(found: Column) -> Column:
    """Nodes in document order, each once."""
    return F.transform(F.sort_array(F.array_distinct(F.transform(found, lambda n: n["node"]))), lambda i: F.get(nodes(), i))


@dataclass(frozen=True)
class Found:
    """What an expression gives: kind is nodes, texts or items (arrays, of nodes, texts, lists of texts), text, number or truth.

    tag is the only element that nodes can be, where that is known.
    """

    kind: str
    column: Column
    tag: str | None = None

    def texts(self) -> Column:
        if self.kind == "nodes":
            return F.transform(self.column, raw)
        if self.kind == "texts":
            return self.column
        if self.kind in ("text", "number"):
            return F.array(self.column.cast("string"))
        raise ValueError(f"{self.kind} can't be read as texts")


@dataclass(frozen=True)
class Place:
    """A node's place among those that a predicate tests, from 1, and how many these are; both made where they are asked for."""

    position: Callable[[], Column]
    last: Callable[[], Column]


@dataclass(frozen=True)
class Paths:
    """Evaluates syntax trees; functions take (paths, node, arguments) and give what they find.

    What is found from `root` is kept in `seen`, so that a plan of many fields builds it once.
    """

    functions: Mapping[str, Callable] = field(default_factory=dict)
    namespaces: Mapping[str, str] | None = None
    root: Column | None = None
    seen: dict = field(default_factory=dict)

    def attribute(self, node: Column, name: str) -> Column:
        prefix, _, local = name.rpartition(":") if "{" not in name else ("", "", name)
        if not prefix:
            return node["attrs"][local]
        known = {"xml": XML, **(self.namespaces or {})}
        if self.namespaces is not None and prefix not in known:
            raise ValueError(f"namespace {prefix} isn't known")
        own = node["attrs"][name]  # as recovered documents have it
        return F.coalesce(node["attrs"][f"{{{known[prefix]}}}{local}"], own) if prefix in known else own

    def find(self, tree, node: Column) -> Found:
        """What an expression gives at a node."""
        if node is not self.root:
            return self.made(tree, node)
        if tree not in self.seen:
            self.seen[tree] = self.made(tree, node)
        return self.seen[tree]

    def made(self, tree, node: Column) -> Found:
        if isinstance(tree, Text):
            return Found("text", F.lit(tree.value))
        if isinstance(tree, Number):
            return Found("number", F.lit(tree.value))
        if isinstance(tree, Union):
            return self.union([self.find(p, node) for p in tree.parts])
        if isinstance(tree, Filter):
            found = self.find(tree.base, node)
            for p in tree.predicates:
                found = self.kept(found, p)
            return found
        if isinstance(tree, Path):
            return self.walk(tree, node)
        if isinstance(tree, Call) and tree.name in self.functions:
            return self.functions[tree.name](self, node, *tree.arguments)
        if isinstance(tree, Call) and tree.name in ("string", "normalize-space", "count"):
            found = self.find(tree.arguments[0] if tree.arguments else Path(None, False, (Step("/", "."),)), node)
            if tree.name == "count":
                return Found("number", F.size(found.column))
            said = F.coalesce(F.get(found.texts(), F.lit(0)), F.lit(""))
            return Found("text", said if tree.name == "string" else F.regexp_replace(F.regexp_replace(said, r"[ \t\r\n]+", " "), "^ | $", ""))
        raise ValueError(f"{tree.name if isinstance(tree, Call) else tree} can't be used here")

    def union(self, parts: list[Found]) -> Found:
        kinds, tags = {p.kind for p in parts}, {p.tag for p in parts}
        if len(kinds) > 1 or kinds - {"nodes", "texts"}:
            raise ValueError(f"| joins nodes or texts, not {sorted(kinds)}")
        every = F.concat(*(p.column for p in parts))
        return Found("nodes", in_order(every), tags.pop() if len(tags) == 1 else None) if kinds == {"nodes"} else Found("texts", every)

    def kept(self, found: Found, predicate) -> Found:
        """What of a list a predicate leaves; its place is that in the list."""
        if isinstance(predicate, Number):
            return Found(found.kind, F.slice(found.column, predicate.value, 1) if predicate.value else F.slice(found.column, 1, 0), found.tag)
        if found.kind != "nodes":
            raise ValueError(f"{found.kind} can only be taken by their place")
        return Found("nodes", let(found.column, lambda xs: F.filter(xs, lambda n, i: self.holds(predicate, n, Place(lambda: i + 1, lambda: F.size(xs))))), found.tag)

    def walk(self, tree: Path, node: Column) -> Found:
        steps = list(tree.steps)
        if tree.base is not None:
            found = self.find(tree.base, node)
        else:
            while not tree.absolute and len(steps) > 1 and steps[0] == Step("/", "."):
                steps = steps[1:]
            run = next((k for k, s in enumerate(steps) if not s.is_element), len(steps))
            if run:
                found = Found("nodes", self.descend(None if tree.absolute else node, steps[:run]), self.tag_of(steps[run - 1]))
                steps = steps[run:]
            elif tree.absolute:
                raise ValueError(f"{steps[0].test} can't begin a path from the root")
            else:
                found = Found("nodes", without_nulls(F.array(node)))
        while steps:
            if found.kind != "nodes":
                raise ValueError(f"there are no steps from {found.kind}")
            run = next((k for k, s in enumerate(steps) if not s.is_element), len(steps))
            if run:
                part = steps[:run]
                found = Found("nodes", in_order(F.flatten(F.transform(found.column, lambda n: self.descend(n, part)))), self.tag_of(part[-1]))
                steps = steps[run:]
            else:
                found, steps = self.other(found, steps[0]), steps[1:]
        return found

    @staticmethod
    def tag_of(step: Step) -> str | None:
        return None if step.test == "*" else step.test

    def other(self, found: Found, step: Step) -> Found:
        """A step that doesn't lead to elements below."""
        base = found.column
        if step.sep == "//":
            if step.test == ".." or step.test == "." or "::" in step.test:
                raise ValueError(f"//{step.test} isn't supported")
            if step.test == "text()":
                return Found("texts", F.flatten(F.transform(base, lambda n: pieces(n, every=True))))
            base = in_order(F.flatten(F.transform(base, lambda n: F.concat(F.array(n), below(n)))))
        if step.test == "text()":
            found = Found("texts", F.flatten(F.transform(base, lambda n: pieces(n))))
        elif step.test == "@*":
            found = Found("texts", F.flatten(F.transform(base, lambda n: F.map_values(n["attrs"]))))
        elif step.test[0] == "@":
            found = Found("texts", without_nulls(F.transform(base, lambda n: self.attribute(n, step.test[1:]))))
        elif step.test == "..":
            found = Found("nodes", in_order(F.filter(F.transform(base, lambda n: F.get(nodes(), n["parent"])), lambda n: n.isNotNull())))
        elif step.test.startswith("self::"):
            found = Found("nodes", F.filter(base, lambda n: n["tag"] == step.test[6:]), step.test[6:])
        if step.predicates and found.kind != "nodes":
            raise ValueError(f"{step.test} can't have predicates")
        alone = Place(lambda: F.lit(1), lambda: F.lit(1))
        for p in step.predicates:
            found = Found("nodes", F.filter(found.column, lambda n: self.holds(p, n, alone)), found.tag)  # noqa: B023
        return found

    def descend(self, base: Column | None, steps: list[Step]) -> Column:
        """Nodes to which steps of elements lead from base, or from above the root: a test of the path, then of predicates along the parents."""
        patterns = ["".join({"//": "(?:/[^/]+)*/", "/": "/"}[s.sep] + ("[^/]+" if s.test == "*" else re.escape(s.test)) for s in steps[:k]) for k in range(len(steps) + 1)]

        def reached(n: Column, k: int) -> Column:
            """Whether the first k steps lead to n."""
            if base is None:
                held = n["path"].rlike(f"^{patterns[k]}$")
            elif k == 1 and steps[0].sep == "/":
                held = n["parent"] == base["node"]
                held = held if steps[0].test == "*" else held & (n["tag"] == steps[0].test)
            elif k == 1:
                held = (n["node"] > base["node"]) & (n["node"] <= base["last"])
                held = held if steps[0].test == "*" else held & (n["tag"] == steps[0].test)
            else:
                held = (n["node"] > base["node"]) & (n["node"] <= base["last"]) & F.substr(n["path"], F.char_length(base["path"]) + 1).rlike(f"^{patterns[k]}$")
            at = n
            for i in range(k - 1, -1, -1):
                held = self.filtered(held, at, steps[i], len(steps[i].predicates))
                if steps[i].sep == "//":
                    if any(s.predicates for s in steps[:i]):
                        held = held & F.exists(nodes(), lambda a: (a["node"] < at["node"]) & (a["last"] >= at["last"]) & reached(a, i))  # noqa: B023
                    break
                at = F.get(nodes(), at["parent"])
            return held

        return F.filter(nodes() if base is None else below(base), lambda n: reached(n, len(steps)))

    def filtered(self, held: Column, n: Column, step: Step, k: int) -> Column:
        """held, and the first k predicates of a step at n. A place is that among the parent's children which the step and its earlier predicates take."""
        for i, p in enumerate(step.predicates[:k]):

            def alike(also: Callable[[Column], Column], i: int = i) -> Column:
                def same(m: Column) -> Column:
                    test = (m["parent"] == n["parent"]) & also(m)
                    return self.filtered(test if step.test == "*" else test & (m["tag"] == step.test), m, step, i)

                up = F.get(nodes(), n["parent"])
                return F.size(F.filter(F.when(up.isNull(), nodes()).otherwise(below(up)), same))

            position = (lambda: n["nth"]) if i == 0 and step.test != "*" else (lambda alike=alike: alike(lambda m: m["node"] <= n["node"]))
            held = held & self.holds(p, n, Place(position, lambda alike=alike: alike(lambda m: F.lit(True))))
        return held

    def holds(self, tree, n: Column, place: Place) -> Column:
        """Whether a predicate holds at a node."""
        if isinstance(tree, Number):
            return place.position() == tree.value
        if isinstance(tree, Op) and tree.sign in ("or", "and"):
            a, b = self.holds(tree.left, n, place), self.holds(tree.right, n, place)
            return a | b if tree.sign == "or" else a & b
        if isinstance(tree, Op):
            return self.compared(tree, n, place)
        if isinstance(tree, Call) and tree.name == "not" and len(tree.arguments) == 1:
            return ~self.holds(tree.arguments[0], n, place)
        if isinstance(tree, Call) and tree.name == "last":
            return place.position() == place.last()
        if isinstance(tree, Call) and tree.name in ("contains", "starts-with") and len(tree.arguments) == 2:
            a, b = (F.coalesce(F.get(self.find(x, n).texts(), F.lit(0)), F.lit("")) for x in tree.arguments)
            return F.contains(a, b) if tree.name == "contains" else F.startswith(a, b)
        if isinstance(tree, Path) and tree.base is None and not tree.absolute and len(tree.steps) == 1 and not tree.steps[0].predicates:
            test = tree.steps[0].test
            if test[0] == "@" and test != "@*":
                return self.attribute(n, test[1:]).isNotNull()
            if test.startswith("self::"):
                return n["tag"] == test[6:]
        found = self.find(tree, n)
        if found.kind == "text":
            return found.column != ""
        return found.column == place.position() if found.kind == "number" else F.size(found.column) > 0

    def compared(self, tree: Op, n: Column, place: Place) -> Column:
        def side(x) -> Found:
            if isinstance(x, Call) and x.name in ("position", "last") and not x.arguments:
                return Found("number", place.position() if x.name == "position" else place.last())
            return self.find(x, n)

        a, b = side(tree.left), side(tree.right)
        by = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[tree.sign]
        if "number" in (a.kind, b.kind) or tree.sign in ("<", ">", "<=", ">="):
            number = lambda f: F.array(f.column.cast("double")) if f.kind == "number" else F.transform(f.texts(), lambda v: v.try_cast("double"))
            xs, ys = number(a), number(b)
        else:
            xs, ys = a.texts(), b.texts()
        return F.exists(xs, lambda x: F.exists(ys, lambda y: F.coalesce(by(x, y), F.lit(False))))
