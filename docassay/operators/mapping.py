"""Fields by a mapping: values are paths with functions, compiled to column expressions when the plan is built.

A field is an array of VALUE: a text, the texts of items, a table, or a table with what surrounds it, told apart by
`kind`. Mapping values that can't be compiled raise ValueError before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extraction as X
from .paths import Found, Paths, Text, let, parse, raw, without_nulls

TABLE = "head:array<array<string>>,body:array<array<string>>"
VALUE = f"struct<kind:string,text:string,items:array<string>,{TABLE},label:string,caption:string>"


def _nodes(paths: Paths, node: Column, trees: tuple, name: str, more: int = 0) -> Column:
    """The first argument of a function, which must be nodes, and be followed by `more` arguments."""
    if len(trees) != 1 + more:
        raise ValueError(f"{name} takes {1 + more} arguments, not {len(trees)}")
    found = paths.find(trees[0], node)
    if found.kind != "nodes":
        raise ValueError(f"{name} takes nodes, not {found.kind}")
    return found.column


def _said(tree, name: str) -> str:
    if not isinstance(tree, Text):
        raise ValueError(f"{name} takes texts in quotes after the nodes")
    return tree.value


def _texts(of: Callable[[Column], Column], name: str, some: bool = False) -> Callable[..., Found]:
    """A function that gives a text for each node; with `some`, for those that have one."""

    def call(paths: Paths, node: Column, *trees) -> Found:
        made = F.transform(_nodes(paths, node, trees, name), of)
        return Found("texts", without_nulls(made) if some else made)

    return call


def _whole(of: Callable[[Column], Column], name: str, kind: str = "texts") -> Callable[..., Found]:
    """A function of all nodes at once."""
    return lambda paths, node, *trees: Found(kind, of(_nodes(paths, node, trees, name)))


def _of_root(of: Callable[[], Column], name: str) -> Callable[..., Found]:
    """A function that finds elements by their way from the root, and so only from there."""

    def call(paths: Paths, node: Column, *trees) -> Found:
        given = _nodes(paths, node, trees, name)
        return Found("nodes", F.when(F.exists(given, lambda n: n["node"] == 0), of()).otherwise(F.filter("nodes", lambda n: F.lit(False))))

    return call


def _concat_children(paths: Paths, node: Column, *trees) -> Found:
    name = "generic-concat-children"
    given = _nodes(paths, node, trees, name, max(0, len(trees) - 1))
    said = [_said(t, name) for t in trees[1:]]
    return Found("texts", F.transform(given, lambda n: X.concat_children(n, *said)))


def _join_children(paths: Paths, node: Column, *trees) -> Found:
    name = "generic-join-children"
    given = _nodes(paths, node, trees, name, 2)
    below_, sep = [parse(x) for x in _said(trees[1], name).split("||")], _said(trees[2], name)
    return Found("texts", F.transform(given, lambda n: X.strip(F.array_join(F.concat(*(paths.find(b, n).texts() for b in below_)), sep))))


def _as_items(paths: Paths, node: Column, *trees) -> Found:
    """The texts that a path gives below each node; of elements those that hold no other one directly."""
    name = "generic-as-items"
    given = _nodes(paths, node, trees, name, 1)
    path = parse(_said(trees[1], name))

    def items(n: Column) -> Column:
        found = paths.find(path, n)
        if found.kind != "nodes":
            return F.transform(found.texts(), X.strip)

        def lowest(xs: Column) -> Column:
            return let(F.transform(xs, lambda x: x["parent"]), lambda up: F.filter(xs, lambda x: ~F.array_contains(up, x["node"])))

        return F.transform(let(found.column, lowest), X.value)

    return Found("items", F.transform(given, items))


#: The functions that mapping values can call.
FUNCTIONS: dict[str, Callable[..., Found]] = {
    "generic-concat-children": _concat_children,
    "generic-join-children": _join_children,
    "generic-as-items": _as_items,
    "generic-text-content": _texts(X.value, "generic-text-content"),
    "generic-normalized-text-content": _texts(X.normalized_text, "generic-normalized-text-content"),
    "generic-strip-brackets": _texts(lambda n: X.strip_brackets(raw(n)), "generic-strip-brackets"),
    "jats-given-name": _texts(X.jats_given_name, "jats-given-name", some=True),
    "jats-full-name": _texts(X.jats_full_name, "jats-full-name", some=True),
    "jats-author-email": _texts(X.jats_author_email, "jats-author-email", some=True),
    "jats-authors": _of_root(X.jats_authors, "jats-authors"),
    "jats-ref-authors": _whole(lambda ns: F.flatten(F.transform(ns, X.jats_ref_authors)), "jats-ref-authors", "nodes"),
    "jats-aff-string": _texts(X.jats_affiliation, "jats-aff-string"),
    "jats-ref-doi": _texts(X.jats_ref_doi, "jats-ref-doi"),
    "jats-ref-fpage": _texts(lambda n: X.jats_ref_pages(n)[0], "jats-ref-fpage"),
    "jats-ref-lpage": _texts(lambda n: F.coalesce(X.jats_ref_pages(n)[1], F.lit("")), "jats-ref-lpage"),
    "tei-given-name": _texts(X.tei_given_name, "tei-given-name", some=True),
    "tei-full-name": _texts(X.tei_full_name, "tei-full-name", some=True),
    "tei-authors": _of_root(X.tei_authors, "tei-authors"),
    "tei-author-affiliations": _of_root(X.tei_author_affiliations, "tei-author-affiliations"),
    "tei-aff-string": _whole(X.tei_affiliations, "tei-aff-string"),
    "tei-aff-text": _whole(X.tei_affiliation_texts, "tei-aff-text"),
    "tei-aff-by-label-text": _whole(X.tei_affiliations_by_label, "tei-aff-by-label-text"),
    "tei-ref-fpage": _texts(lambda n: X.tei_ref_pages(n)[0], "tei-ref-fpage"),
    "tei-ref-lpage": _texts(lambda n: X.tei_ref_pages(n)[1], "tei-ref-lpage"),
    "tei-ref-publication-type": _texts(X.tei_ref_publication_type, "tei-ref-publication-type"),
    "tei-abstract-text": _texts(X.tei_abstract, "tei-abstract-text"),
}


def _value(kind: str, **parts: Column) -> Column:
    names = ("text", "items", "head", "body", "label", "caption")
    return F.struct(F.lit(kind).alias("kind"), *(parts.get(n, F.lit(None)).alias(n) for n in names)).cast(VALUE)


def typed(n: Column, tag: str | None, said: Callable[[Column], Column] = X.value) -> Column:
    """VALUE of a node by its tag, which may be known when the plan is built."""
    made = {
        "table": lambda: let(X.table(n), lambda t: _value("table", head=t["head"], body=t["body"])),
        "table-wrap": lambda: let(X.table_wrap(n), lambda w: _value("table-wrap", head=w["table"]["head"], body=w["table"]["body"], label=w["label"], caption=w["caption"])),
        "items": lambda: _value("items", items=F.transform(X.under(n, "item", direct=True), X.value)),
    }
    text = _value("text", text=said(n))
    if tag is not None:
        return made[tag]() if tag in made else text
    for t, of in made.items():
        text = F.when(n["tag"] == t, of()).otherwise(text)
    return text


def compiled(paths: Paths, value: str, ignore: str | None = None) -> Column:
    """array<VALUE> of a mapping value at the document's root; nodes of the path `ignore` below a node only leave a mark in its text."""
    found = paths.find(parse(value), paths.root)
    if found.kind == "nodes":
        skipped = None if ignore is None else parse(ignore)

        def said(n: Column) -> Column:
            if skipped is None:
                return X.value(n)
            gone = paths.find(skipped, n)
            if gone.kind != "nodes":
                raise ValueError(f"what is ignored must be nodes: {ignore!r}")
            return X.text_ignoring(n, gone.column)

        return F.transform(found.column, lambda n: typed(n, found.tag, said))
    if found.kind == "items":
        return F.transform(found.column, lambda xs: _value("items", items=xs))
    return F.transform(found.texts(), lambda x: _value("text", text=X.strip(x)))


def with_fields(shredded: DataFrame, mappings: Mapping[str, Mapping[str, str]], only: Sequence[str] | None = None) -> DataFrame:
    """Adds `fields`, a map of arrays of VALUE by the mapping of the root's tag, and says in `error` if there is none.

    Keys of a mapping that hold .ignore are no fields; its section `namespaces` names the prefixes of attributes.
    """
    paths = Paths(FUNCTIONS, dict(mappings.get("namespaces") or {}), F.get("nodes", F.lit(0)))
    tag = F.get("nodes", F.lit(0))["tag"]
    made = F.lit(None).cast(f"map<string,array<{VALUE}>>")
    for root, mapping in mappings.items():
        chosen = [f for f in mapping if ".ignore" not in f and (only is None or f in only)]
        if root == "namespaces" or not chosen:
            continue
        columns: list[Column] = []
        for f in chosen:
            try:
                columns += [F.lit(f), compiled(paths, mapping[f], mapping.get(f"{f}.ignore"))]
            except ValueError as e:
                raise ValueError(f"mapping [{root}] {f}: {e}") from e
        made = F.when(tag == root, F.create_map(*columns)).otherwise(made)
    unknown = F.when(F.size("nodes") > 0, F.concat(F.lit("unrecognised tag: "), tag)).otherwise("no document")
    return shredded.withColumn("fields", made).withColumn("error", F.coalesce("error", F.when(F.col("fields").isNull(), unknown)))


def texts(values: Column) -> Column:
    """The texts of an array of VALUE: items joined with blanks, cells of tables by rows with blanks, labels and captions before them."""
    cells = lambda v: F.flatten(F.concat(v["head"], v["body"]))
    row = lambda v: F.when(v["kind"] == "text", v["text"]).when(v["kind"] == "items", F.array_join(v["items"], " ")).otherwise(X.strip(F.concat_ws(" ", v["label"], v["caption"], cells(v))))
    return F.transform(values, row)


def as_json(fields: Column) -> Column:
    """A map of arrays of VALUE as JSON: texts, {"items": ...}, {"head": ..., "body": ...}, or a table within label and caption."""
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")

    def one(v: Column) -> Column:
        table = F.to_json(F.struct(v["head"].alias("head"), v["body"].alias("body")))
        wrap = F.concat(F.lit('{"label":'), quoted(v["label"]), F.lit(',"caption":'), quoted(v["caption"]), F.lit(',"table":'), table, F.lit("}"))
        return F.when(v["kind"] == "items", F.to_json(F.struct(v["items"].alias("items")))).when(v["kind"] == "table", table).when(v["kind"] == "table-wrap", wrap).otherwise(quoted(v["text"]))

    entry = lambda e: F.concat(F.lit("  "), quoted(e["key"]), F.lit(": ["), F.array_join(F.transform(e["value"], one), ", "), F.lit("]"))
    return F.concat(F.lit("{\n"), F.array_join(F.transform(F.map_entries(fields), entry), ",\n"), F.lit("\n}"))
