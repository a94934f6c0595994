"""Fields of XML and HTML documents, taken by column expressions from a document's nodes.

`shred` puts each document into one row: its text, and its nodes in document order with parent, last descendant,
path, attributes and the range of the text that they hold. Selecting, joining and formatting nodes are then
higher-order functions within the row, so extraction needs no shuffle and no Python after the parse.
"""

from __future__ import annotations

import html as html_text
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as T
from . import paths
from .paths import Found, below, nonempty, pieces, raw, without_nulls
from .paths import let as _let

NODES = "array<struct<node:int,parent:int,last:int,tag:string,nth:int,path:string,attrs:map<string,string>,start:int,lead:int,end:int>>"
#: Elements of HTML that have no end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Noncharacters, of which one that a document lacks stands for an ampersand that is text.
SPARE = [chr(c) for c in range(0xFDD0, 0xFDF0)]


class _Nodes(HTMLParser):
    """Takes start, end and text events of either parser, closing what is left open."""

    html = True

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.mark = ""
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.parts: list[str] = []
        self.like: dict[tuple[int, str], int] = {}
        self.at = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        tag = tag.rpartition("}")[2]
        up = self.nodes[self.open[-1]] if self.open else {"node": -1, "path": ""}
        n = len(self.nodes)
        if "lead" in up and up["lead"] is None:
            up["lead"] = self.at
        kept = {}
        for k, v in attrs:
            kept.setdefault(k, self.said(v or ""))
        nth = self.like[up["node"], tag] = self.like.get((up["node"], tag), 0) + 1
        self.nodes.append({"node": n, "parent": up["node"], "last": n, "tag": tag, "nth": nth, "path": f"{up['path']}/{tag}", "attrs": list(kept.items()), "start": self.at, "lead": None, "end": self.at})
        self.open.append(n)
        if tag in VOID and self.html:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        tag = tag.rpartition("}")[2]
        if any(self.same(self.nodes[i]["tag"], tag) for i in self.open):
            while self.open:
                n = self.nodes[self.open.pop()]
                n |= {"last": len(self.nodes) - 1, "end": self.at, "lead": self.at if n["lead"] is None else n["lead"]}
                if self.same(n["tag"], tag):
                    break

    def same(self, a: str, b: str) -> bool:
        return a == b

    def handle_data(self, data: str) -> None:
        data = self.said(data)
        self.parts.append(data)
        self.at += len(data)

    def only(self, source: str, names: Sequence[str]) -> str:
        """source with all ampersands marked but those of these names with their semicolon; said() undoes it."""
        self.mark = next(c for c in SPARE if c not in source)
        return re.sub(f"&(?!(?:{'|'.join(names)});)", self.mark, source)

    def said(self, text: str) -> str:
        return text.replace(self.mark, "&") if self.mark else text

    def done(self) -> tuple[str, list[dict]]:
        for tag in [self.nodes[i]["tag"] for i in reversed(self.open)]:
            self.handle_endtag(tag)
        return "".join(self.parts), self.nodes


class _Recovering(_Nodes):
    """Takes what it can of XML that isn't well-formed: case and the first of equal attributes are kept, text outside the root isn't."""

    html = False
    CDATA_CONTENT_ELEMENTS = RCDATA_CONTENT_ELEMENTS = ()

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.nodes and not self.open:
            return
        said = self.get_starttag_text() or f"<{tag}"
        name = re.match(r"</?\s*([^\s/>]+)", said)
        own = [(k, html_text.unescape(a or b)) for k, a, b in re.findall(r"([^\s=<>/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", said)]
        local = (name.group(1) if name else tag).rpartition(":")[2]
        super().handle_starttag(local, [(k, v) for k, v in own if not k.startswith("xmlns")])

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag.rpartition(":")[2])

    def same(self, a: str, b: str) -> bool:
        return a.lower() == b.lower()

    def handle_data(self, data: str) -> None:
        if self.open:
            super().handle_data(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


class _Target:
    """Hands the XML parser's events on."""

    def __init__(self) -> None:
        self.to = _Nodes()
        self.to.html = False

    def start(self, tag, attrib) -> None:
        self.to.handle_starttag(tag, attrib.items())

    def end(self, tag) -> None:
        self.to.handle_endtag(tag)

    def data(self, data) -> None:
        self.to.handle_data(data)

    def close(self):
        return self.to.done()


def _tolerant(source: str | bytes, parser: _Nodes, names: Sequence[str] | None = None) -> tuple[str, list[dict]]:
    text = source if isinstance(source, str) else source.decode("utf-8", "replace")
    parser.feed(text if names is None else parser.only(text, names))
    parser.close()
    return parser.done()


def _parsed(source: str | bytes | None, html: bool, names: Sequence[str] | None = None) -> tuple[str, list[dict], str | None]:
    if source is None:
        return "", [], None
    if html:
        return *_tolerant(source, _Nodes(), names), None
    parser = ET.XMLParser(target=_Target())
    try:
        parser.feed(source)
        return *parser.close(), None
    except ET.ParseError as e:
        content, nodes = _tolerant(source, _Recovering())
        return content, nodes, None if nodes else str(e)


def shred(docs: DataFrame, source: str, keys: list[str], html: bool = False, names: Sequence[str] | None = None) -> DataFrame:
    """keys, `content`, `nodes` and `error` (no element at all) of each document in column `source`; XML is recovered as far as it can be.

    Where `names` are given, HTML's references to characters are text but for these names with a semicolon.
    """
    kept = docs.select(*keys, source)
    out = kept.schema[:-1].add("content", "string").add("nodes", _parse_datatype_string(NODES)).add("error", "string")
    arrow = to_arrow_type(_parse_datatype_string(NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):  # few documents at once, as nodes are larger than the source
                part = b.slice(i, 64)
                made = [_parsed(x.as_py(), html, names) for x in part.column(len(keys))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], arrow), pa.array([m[2] for m in made], pa.string())], names=[*keys, "content", "nodes", "error"])

    return kept.mapInArrow(run, out)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def value(node: Column) -> Column:
    """A node's text, stripped."""
    return strip(raw(node))


def lead(node: Column) -> Column:
    """The text before a node's first child; null without any."""
    return F.nullif(F.substring(F.col("content"), node["start"] + 1, node["lead"] - node["start"]), F.lit(""))


def _nodes(found: Found) -> Column:
    if found.kind != "nodes":
        raise ValueError("the path leads to texts, not to elements")
    return found.column


def _anywhere(tree):
    """A path that doesn't begin with / leads to nodes wherever they are."""
    if isinstance(tree, paths.Union):
        return paths.Union(tuple(map(_anywhere, tree.parts)))
    if isinstance(tree, paths.Path) and tree.base is None and not tree.absolute:
        return paths.Path(None, True, (paths.Step("//", tree.steps[0].test, tree.steps[0].predicates), *tree.steps[1:]))
    return tree


def select(path: str) -> Column:
    """Nodes of a path of steps with / and //, with predicates; | joins paths, in document order."""
    return _nodes(paths.Paths().find(_anywhere(paths.parse(path)), F.get("nodes", F.lit(0))))


def relative(node: Column, path: str) -> Column:
    """Nodes of a path below a node: a/b or .//a."""
    return _nodes(paths.Paths().find(paths.parse(path), node))


def under(node: Column, tags: str, direct: bool = False) -> Column:
    """Descendants, or only children, of a node with one of the tags a|b; * for any."""
    inside = below(node)
    if direct:
        inside = F.filter(inside, lambda n: n["parent"] == node["node"])
    return inside if tags == "*" else F.filter(inside, lambda n: n["tag"].isin(*tags.split("|")))


def child(node: Column, tag: str) -> Column:
    """The first child with a tag; null without one."""
    return F.get(under(node, tag, direct=True), F.lit(0))


def first(node: Column, tags: str, direct: bool = False) -> Column:
    """Text of the first such descendant, or an empty text."""
    return F.coalesce(value(F.get(under(node, tags, direct), F.lit(0))), F.lit(""))


def first_lead(nodes: Column) -> Column:
    """Leading text of the first of some nodes: null without a node, empty without text."""
    return F.when(F.size(nodes) > 0, F.coalesce(lead(F.get(nodes, F.lit(0))), F.lit("")))


def texts(path: str) -> Column:
    return F.transform(select(path), value)


def attributes(path: str, name: str) -> Column:
    return F.filter(F.transform(select(path), lambda n: n["attrs"][name]), lambda v: v.isNotNull())


def concat_children(node: Column, *expressions: str) -> Column:
    """The texts of first children ($name) and literals, one behind the other."""
    parts = [F.coalesce(raw(child(node, e[1:])), F.lit("")) if e.startswith("$") else F.lit(e) for e in expressions]
    return strip(F.concat(*parts))


def join_children(node: Column, expressions: str, sep: str) -> Column:
    """Texts of the nodes of relative paths; those of a path in document order, paths between || in the order given."""
    parts = F.concat(*(F.transform(relative(node, p), raw) for p in expressions.split("||")))
    return strip(F.array_join(parts, sep))


def joined(node: Column, tags: str, sep: str) -> Column:
    """Texts of the descendants with one of the tags, the tags in the order given."""
    parts = F.concat(*(F.transform(under(node, t), value) for t in tags.split("|")))
    return F.trim(F.array_join(parts, sep))


def items(node: Column, tags: str) -> Column:
    """Texts of the descendants with one of the tags that don't directly hold another of them."""
    return _let(under(node, tags), lambda found: F.transform(F.filter(found, lambda n: ~F.exists(found, lambda m: m["parent"] == n["node"])), value))


def strip_brackets(s: Column) -> Column:
    """Without one pair of brackets around the text."""
    return F.when(s.rlike(r"(?s)^(?:\[.*\]|\(.*\)|\{.*\})$"), strip(F.substr(s, F.lit(2), F.char_length(s) - 2))).otherwise(s)


def normalized_text(node: Column) -> Column:
    """A node's text with a blank between words that only tags part, single spaces, and none before . , and :."""
    empty = F.struct(F.lit("").alias("text"), F.lit("").alias("last"))

    def add(s: Column, x: Column) -> Column:
        gap = F.when(s["last"].rlike(r"(?dU)^.*\w$") & x.rlike(r"(?U)^\w"), " ").otherwise("")
        return F.struct(F.concat(s["text"], gap, x).alias("text"), x.alias("last"))

    whole = F.aggregate(pieces(node, every=True), empty, add, lambda s: s["text"])
    return F.regexp_replace(strip(T.normalize_whitespace(whole)), r" (?=[.,:])", "")


def text_without(node: Column, gone: Column) -> Column:
    """A node's text less those of some of its descendants, which don't hold each other."""
    start = F.concat(F.array(node["start"]), F.transform(gone, lambda n: n["end"]))
    end = F.concat(F.transform(gone, lambda n: n["start"]), F.array(node["end"]))
    return F.array_join(F.zip_with(start, end, lambda a, b: F.substring(F.col("content"), a + 1, b - a)), "")


def text_ignoring(node: Column, ignored: Column) -> Column:
    """A node's text with a mark for each ignored descendant; of nodes that begin with text only their own text counts."""
    within = F.filter(ignored, lambda i: (i["node"] > node["node"]) & (i["node"] <= node["last"]))

    def skipped(n: Column) -> Column:
        return F.exists(within, lambda i: i["node"] == n["node"])

    def reached(n: Column) -> Column:
        above = lambda a: (a["node"] >= node["node"]) & (a["node"] < n["node"]) & (a["last"] >= n["last"])
        return (n["node"] >= node["node"]) & (n["node"] <= node["last"]) & ~F.exists("nodes", lambda a: above(a) & ((a["lead"] > a["start"]) | skipped(a)))

    said = lambda n: F.when(skipped(n), F.lit(" _ignore_ ")).when(n["lead"] > n["start"], F.array_join(pieces(n), "")).otherwise("")
    return strip(F.when(F.size(within) == 0, raw(node)).otherwise(F.array_join(F.transform(F.filter("nodes", reached), said), "")))


def natural(s: Column) -> Column:
    """Sort key by which numbers in texts count as numbers."""
    parts = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.char_length(number(p)).cast("string"), 6, "0"), number(p))).otherwise(p))


def sorted_naturally(nodes: Column, name: str) -> Column:
    """Nodes by an attribute in natural order; equal ones stay in order."""
    order = F.sort_array(F.transform(nodes, lambda n, i: F.struct(natural(n["attrs"][name]).alias("key"), i.alias("i"))))
    return F.transform(order, lambda o: F.get(nodes, o["i"]))


def _person(parts: Column) -> Column:
    return T.person_name(F.array_join(nonempty(parts), " "))


def _own_or_child(node: Column, tag: str) -> Column:
    return F.when(node["tag"] == tag, node).otherwise(child(node, tag))


def _leads(node: Column, *tags: str) -> Column:
    return F.array(*(F.coalesce(lead(child(node, t)), F.lit("")) for t in tags))


def _jats_name(node: Column, tags: tuple[str, ...], bare: bool) -> Column:
    def of(names: Column) -> Column:
        loose = _person(_leads(names["loose"], *tags))
        rest = F.when(loose != "", loose).otherwise(lead(names["loose"]) if bare else F.lit(None).cast("string"))
        return F.when(names["name"].isNotNull(), _person(_leads(names["name"], *tags))).when(names["loose"].isNotNull(), rest)

    return _let(F.struct(_own_or_child(node, "name").alias("name"), _own_or_child(node, "string-name").alias("loose")), of)


def jats_given_name(node: Column) -> Column:
    """Initials without stops; null for people without a name, so that they can be left out."""
    return _jats_name(node, ("given-names",), False)


def jats_full_name(node: Column) -> Column:
    """Given names and surname; the text of a string-name without either; null for people without a name."""
    return _jats_name(node, ("given-names", "surname"), True)


def jats_authors() -> Column:
    """The contributors that are authors, or of no type, in groups of the same."""
    author = lambda n, *types: n["attrs"]["contrib-type"].isNull() | n["attrs"]["contrib-type"].isin(*types)
    found = F.filter("nodes", lambda n: n["path"].rlike(r"^/[^/]+/front/article-meta/contrib-group/contrib$"))
    return F.filter(found, lambda n: author(n, "author", "person") & author(F.get(F.col("nodes"), n["parent"]), "author"))


def jats_author_email(node: Column) -> Column:
    """A contributor's address, or that of the author's note to which it refers; null without any."""
    notes = F.filter("nodes", lambda n: n["path"].rlike("/author-notes/[^/]+/email$"))
    refs = F.filter(F.transform(under(node, "xref", direct=True), lambda x: x["attrs"]["rid"]), lambda r: F.coalesce(r, F.lit("")) != "")
    of = F.flatten(F.transform(refs, lambda r: F.filter(notes, lambda n: F.get(F.col("nodes"), n["parent"])["attrs"]["id"] == r)))
    return F.get(nonempty(F.transform(F.concat(under(node, "email", direct=True), of), raw)), F.lit(0))


def jats_ref_authors(node: Column) -> Column:
    """Names in a reference, then its string-names."""
    return F.concat(under(node, "name"), under(node, "string-name"))


#: Fixed value: the parts of an affiliation, in order.
PARTS = "institution|addr-line|city|country"


def jats_affiliation(node: Column) -> Column:
    """The whole text if there is text outside the parts, else the parts that are given, else its text without labels."""
    parts = F.concat(*(F.transform(under(node, t, direct=True), lambda n: F.coalesce(lead(n), F.lit(""))) for t in PARTS.split("|")))
    own = F.array_join(nonempty(parts), ", ")
    bare = strip(text_without(node, under(node, "label", direct=True)))
    return F.when(F.exists(pieces(node), lambda p: strip(p) != ""), normalized_text(node)).when(own != "", own).otherwise(bare)


def jats_ref_doi(node: Column) -> Column:
    """The identifier of a reference, from its own element, else from a link to it."""
    ids = F.filter(under(node, "pub-id"), lambda n: n["attrs"]["pub-id-type"] == "doi")
    links = F.filter(under(node, "ext-link"), lambda n: n["attrs"]["ext-link-type"] == "uri")
    href = lambda n: F.get(F.map_values(F.map_filter(n["attrs"], lambda k, v: k.endswith("href"))), F.lit(0))
    return F.coalesce(first_lead(ids), F.get(without_nulls(F.transform(links, lambda n: T.doi_from_url(href(n)))), F.lit(0)), F.lit(""))


def jats_ref_pages(node: Column) -> tuple[Column, Column]:
    """First and last page, the last one filled up from the first, and equal to it where there is none."""
    a = F.coalesce(first_lead(under(node, "fpage")), F.lit(""))
    b = first_lead(under(node, "lpage"))
    return a, F.when(b == "", "").otherwise(T.last_page(a, b))


def _tei_name(node: Column, surname: bool) -> Column:
    def of(name: Column) -> Column:
        parts = F.transform(under(name, "forename", direct=True), raw)
        if surname:
            parts = F.concat(parts, F.array(F.coalesce(raw(child(name, "surname")), F.lit(""))))
        return F.when(name.isNotNull(), _person(parts))

    return _let(_own_or_child(node, "persName"), of)


def tei_given_name(node: Column) -> Column:
    """All forenames; null for authors without a persName."""
    return _tei_name(node, False)


def tei_full_name(node: Column) -> Column:
    return _tei_name(node, True)


def tei_authors() -> Column:
    return F.filter("nodes", lambda n: n["path"].rlike(r"^/[^/]+/teiHeader/fileDesc/sourceDesc/biblStruct/analytic/author$"))


def first_by_attribute(nodes: Column, name: str) -> Column:
    """Nodes less those whose attribute an earlier one has; nodes without it, or with an empty one, stay."""
    earlier = lambda n: F.exists(nodes, lambda m: (m["node"] < n["node"]) & (m["attrs"][name] == n["attrs"][name]))
    return F.filter(nodes, lambda n: (F.coalesce(n["attrs"][name], F.lit("")) == "") | ~earlier(n))


def tei_author_affiliations() -> Column:
    """Affiliations of the authors, the first of each key."""
    return first_by_attribute(F.flatten(F.transform(tei_authors(), lambda a: under(a, "affiliation", direct=True))), "key")


def _notes(node: Column) -> Column:
    return F.filter(under(node, "note", direct=True), lambda n: n["attrs"]["type"] == "raw_affiliation")


def _joined_raw(nodes: Column) -> Column:
    return F.array_join(nonempty(F.transform(nodes, raw)), ", ")


def tei_affiliation(node: Column) -> Column:
    """An affiliation's raw notes, else its organisations and the parts of its address."""
    parts = F.concat(under(node, "orgName", direct=True), *(relative(node, f"address/{t}") for t in ("addrLine", "postCode", "settlement", "country")))
    return _let(_notes(node), lambda notes: F.when(F.size(notes) > 0, _joined_raw(notes)).otherwise(_joined_raw(parts)))


def tei_affiliations(nodes: Column) -> Column:
    """Texts of affiliations in natural order of their keys."""
    return F.transform(sorted_naturally(nodes, "key"), tei_affiliation)


def tei_affiliation_texts(nodes: Column) -> Column:
    """Only the raw notes of affiliations, in natural order of their keys."""
    return F.transform(sorted_naturally(nodes, "key"), lambda n: _joined_raw(_notes(n)))


def tei_affiliations_by_label(nodes: Column) -> Column:
    """Raw notes in natural order of the keys; those that follow each other under one label are one text.

    A note without a label is given at once, before the text that is being put together.
    """
    notes = F.flatten(F.transform(sorted_naturally(nodes, "key"), _notes))

    def said(n: Column) -> Column:
        labels = under(n, "label", direct=True)
        return F.struct(F.array_join(F.transform(labels, raw), "").alias("label"), raw(n).alias("text"), strip(text_without(n, labels)).alias("rest"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("label"), F.lit("").alias("pending"))

    def state(out: Column, label: Column, pending: Column) -> Column:
        return F.struct(out.alias("out"), label.alias("label"), pending.alias("pending"))

    def step(s: Column, n: Column) -> Column:
        more = state(s["out"], s["label"], F.concat(s["pending"], F.lit(" "), n["rest"]))
        other = state(F.concat(s["out"], nonempty(F.array(s["pending"]))), n["label"], n["text"])
        alone = state(F.concat(s["out"], F.array(n["text"])), s["label"], s["pending"])
        return F.when(n["label"] == "", alone).when((s["pending"] != "") & (n["label"] == s["label"]), more).otherwise(other)

    return F.aggregate(F.transform(notes, said), start, step, lambda s: F.concat(s["out"], nonempty(F.array(s["pending"]))))


def _page_scopes(node: Column) -> Column:
    return F.filter(under(node, "biblScope"), lambda n: n["attrs"]["unit"] == "page")


def _scope(node: Column, name: str) -> Column:
    return F.get(without_nulls(F.transform(_page_scopes(node), lambda n: n["attrs"][name])), F.lit(0))


def tei_ref_pages(node: Column) -> tuple[Column, Column]:
    """First page, from the attribute or the text, and last page, equal to the first where there is none."""
    a = F.coalesce(_scope(node, "from"), first_lead(_page_scopes(node)), F.lit(""))
    return a, F.coalesce(_scope(node, "to"), a)


def tei_ref_publication_type(node: Column) -> Column:
    """journal or book by the level of a title; the first page without either, as the results to match have it."""
    level = lambda v: F.exists(under(node, "title"), lambda n: n["attrs"]["level"] == v)
    return F.when(level("j"), "journal").when(level("m"), "book").otherwise(tei_ref_pages(node)[0])


def tei_abstract(node: Column) -> Column:
    """The texts of all nodes in the divisions but the first head, each whole; without divisions the abstract's text."""
    head = F.get(under(node, "head"), F.lit(0))["node"]
    inner = lambda d: F.transform(F.filter(under(d, "*"), lambda n: F.coalesce(n["node"] != head, F.lit(True))), raw)
    return _let(under(node, "div"), lambda divs: F.when(F.size(divs) == 0, raw(node)).otherwise(F.array_join(F.flatten(F.transform(divs, inner)), " ")))


def table(node: Column) -> Column:
    """struct<head, body> of a table's own rows: th of thead, td of tbody; without these td of rows, or cell of row."""

    def rows(path: str, cell: str) -> Column:
        return F.transform(relative(node, path), lambda r: F.transform(under(r, cell, direct=True), value))

    def of(t: Column) -> Column:
        loose = F.when(F.size(t["loose"]) > 0, t["loose"]).otherwise(t["cells"])
        none = (F.size(t["head"]) == 0) & (F.size(t["body"]) == 0)
        return F.struct(t["head"].alias("head"), F.when(none, loose).otherwise(t["body"]).alias("body"))

    return _let(F.struct(rows("thead/tr", "th").alias("head"), rows("tbody/tr", "td").alias("body"), rows("tr", "td").alias("loose"), rows("row", "cell").alias("cells")), of)


def table_rows(node: Column) -> Column:
    """Cells of each row of a table, head before body."""
    return _let(table(node), lambda t: F.concat(t["head"], t["body"]))


def table_wrap(node: Column) -> Column:
    """struct<label, caption, table> of what surrounds a table; empty where it is missing."""
    part = lambda tag: F.coalesce(value(child(node, tag)), F.lit(""))
    return F.struct(part("label").alias("label"), part("caption").alias("caption"), _let(child(node, "table"), table).alias("table"))


def field(mapping: dict[str, str], name: str) -> Column:
    """A field's texts; nodes of the path <name>.ignore only leave a mark."""
    ignored = mapping.get(f"{name}.ignore")
    return texts(mapping[name]) if ignored is None else F.transform(select(mapping[name]), lambda n: text_ignoring(n, select(ignored)))


def with_fields(shredded: DataFrame, mapping: dict[str, str], only: list[str] | None = None) -> DataFrame:
    """Adds an array of texts for each field of the mapping (field: path); keys that hold .ignore are no fields."""
    chosen = [f for f in mapping if ".ignore" not in f and (only is None or f in only)]
    return shredded.withColumns({f: field(mapping, f) for f in chosen})
