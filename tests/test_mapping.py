"""Mapping values, typed fields and their scores; matching out of order and of items, beside plain models."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from docassay import __main__ as cli
from docassay.operators import extraction as X, mapping as M, matching, paths, scoring
from docassay.sources import files

ARTICLE = """<article xmlns:tei="http://www.tei-c.org/ns/1.0" xmlns:xlink="u"><front><article-meta><title-group><article-title>On <i>x</i> things</article-title></title-group>
<contrib-group><contrib contrib-type="author" corresp="yes"><name><surname>Reed</surname><given-names>A.</given-names></name></contrib>
<contrib><name><surname>Doe</surname><given-names>B. C.</given-names></name></contrib></contrib-group></article-meta></front>
<body><sec><label>1</label><title>One</title><p>a</p><p>b</p><sec><title>Inner</title></sec></sec><fig><graphic tei:coords="1,2,3,4,5"/><graphic tei:coords="no"/></fig>
<table-wrap id="t"><label>T1</label><caption><title>Cap</title></caption><table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td><td> 2 </td></tr></tbody></table></table-wrap>
<table-wrap><table><row><cell>r</cell></row></table></table-wrap></body>
<back><ack><p>Thanks</p></ack><ref><article-title>T</article-title><year>2001</year><x kind="journal"/></ref><ref><chapter-title>C</chapter-title><year>2002</year><year>2003</year></ref><sec><title>Last</title></sec></back></article>"""
TEXTS = {
    "front/article-meta/title-group/article-title": ["On x things"],
    "title": [],  # from the root only, not anywhere
    "jats-authors(.)/name/surname": ["Reed", "Doe"],
    "jats-authors(.)[1]/name/surname": ["Reed"],
    "jats-authors(.)[last()]/name/given-names": ["B. C."],
    "jats-authors(.)[position() > 1]/name/surname": ["Doe"],
    'jats-authors(.)[@corresp="yes"]/name/surname': ["Reed"],
    "jats-full-name(jats-authors(.))": ["A Reed", "BC Doe"],
    "jats-given-name(jats-authors(.)[2])": ["BC"],
    "(back//ref)[1]/year": ["2001"],
    "back//ref[1]/year": ["2001"],
    "back//year[1]": ["2001", "2002"],
    "(back//year)[last()]": ["2003"],
    "back//year[2]": ["2003"],
    "back/*[2]/year": ["2001"],
    "back/*[year][2]/year[1]": ["2002"],
    "generic-join-children(back//ref, './/*[self::article-title or self::chapter-title]', ', ')": ["T", "C"],
    "generic-join-children((back//ref)[2], './/year', '; ')": ["2002; 2003"],
    "generic-join-children(back//ref, './*/@kind', ' ')": ["journal", ""],
    "generic-join-children(body//sec, 'p', '\n')[1]": ["a\nb"],
    "generic-join-children(back/ack[p] | back//sec[p], 'p', ' ')": ["Thanks"],
    "generic-join-children((body/sec)[1]/title, './@n || . || ../label', '-')": ["One-1"],
    "generic-concat-children((body//sec | back//sec), '$label', ' ', '$title')": ["1 One", "Inner", "Last"],
    "(back//sec | body//sec)/title": ["One", "Inner", "Last"],
    "(body | back)//fig//graphic[1]/@tei:coords": ["1,2,3,4,5"],
    "body//graphic[not(contains(@tei:coords, 'n'))]/@tei:coords": ["1,2,3,4,5"],
    "body/sec/p/text()": ["a", "b"],
    "(//p)[3]": ["Thanks"],
    "generic-strip-brackets(body//sec/label)": ["1"],
    "generic-text-content((body)//table-wrap/table)": ["h1 2", "r"],
    "generic-normalized-text-content(body//table-wrap[@id='t']/caption)": ["Cap"],
    "body/sec[title = 'One' and count(p) = 2]/label": ["1"],
    "body/sec[title != 'One']/label": [],
    "body/sec[starts-with(title, 'O')]/title | back/sec[not(starts-with(title, 'O'))]/title": ["One", "Last"],
    "back//year[. >= 2002]": ["2002", "2003"],
    "body/sec/sec/..//title": ["One", "Inner"],
}


@pytest.fixture(scope="module")
def made(spark):
    return X.shred(spark.createDataFrame([(1, ARTICLE)], "id int, xml string"), "xml", ["id"]).cache()


def test_values_of_mappings(made):
    mapping = {"article": {str(i): p for i, p in enumerate(TEXTS)}, "namespaces": {"tei": "http://www.tei-c.org/ns/1.0"}}
    row = M.with_fields(made, mapping).first()
    assert row.error is None
    assert {p: [v.text for v in row.fields[str(i)]] for i, p in enumerate(TEXTS)} == TEXTS
    assert {v.kind for vs in row.fields.values() for v in vs} == {"text"}


@pytest.mark.parametrize("path", ["a b", "a[", "//", "@", "foo::a", "tei:x", "none(.)", "jats-authors(title, 1)", "title/@x/y", "generic-as-items(ref, x)", "title[@x]/text()[@y]", "a/@no:x", "//.//x", "generic-join-children(ref, 'a[', ' ')", "a | @x", "generic-text-content(a/@x)"])
def test_values_that_cannot_be_read_raise(made, path):
    with pytest.raises(ValueError):
        M.with_fields(made, {"article": {"f": path}, "namespaces": {}})


def test_old_paths_raise_too():
    for p in ("//a[", "//a/@x", "a/text()", "f(//a)"):
        with pytest.raises(ValueError):
            X.select(p)


def test_kinds_and_json(made):
    mapping = {"article": {"tables": "body//table", "wraps": "body/table-wrap", "any": "body/*[label or table]", "items": "generic-as-items(back/ref, './/*')", "t": "//article-title", "t.ignore": "i", "none": "x"}}
    row = M.with_fields(made, mapping).select("*", M.as_json(F.col("fields")).alias("json"), M.texts(F.col("fields")["any"]).alias("texts")).first()
    one, two = ({"head": [["h"]], "body": [["1", "2"]]}, {"head": [], "body": [["r"]]})
    got = json.loads(row.json)
    assert got["tables"] == [one, two] and got["wraps"] == [{"label": "T1", "caption": "Cap", "table": one}, {"label": "", "caption": "", "table": two}]
    assert got["items"] == [{"items": ["T", "2001", ""]}, {"items": ["C", "2002", "2003"]}] and got["t"] == ["On  things", "T"] and got["none"] == []
    assert [v.kind for v in row.fields["any"]] == ["text", "table-wrap", "table-wrap"] and row.texts[1:] == ["T1 Cap h 1 2", "r"]


def test_unknown_roots(spark):
    docs = spark.createDataFrame([(1, "<a><b>x</b></a>"), (2, "<c/>"), (3, "none"), (4, None)], "id int, xml string")
    rows = M.with_fields(X.shred(docs, "xml", ["id"]), {"a": {"f": "b"}}).orderBy("id").collect()
    assert [r.error is None for r in rows] == [True, False, False, False] and rows[1].error == "unrecognised tag: c"


def typed_pairs(spark, expected, actual, mapping):
    sides = spark.createDataFrame([(1, expected, actual)], "id int, e string, a string")
    e = M.with_fields(X.shred(sides, "e", ["id", "a"]), mapping).select("id", "a", F.col("fields").alias("expected"))
    return M.with_fields(X.shred(e, "a", ["id", "expected"]), mapping).select("id", "expected", F.col("fields").alias("actual"))


def test_typed_fields_by_settings(spark):
    doc = "<d><table><tr><td>{}</td></tr></table><table><tr><td>same</td></tr></table><n>One</n><r><y>abc</y><y>de</y></r></d>"
    mapping = {"d": {"tables": "table", "name": "n", "refs": "generic-as-items(r, 'y')"}}
    pairs = typed_pairs(spark, doc.format("x"), doc.format("y"), mapping)
    types = {"tables": ["partial_table", "table"], "refs": ["list", "partial_list", "partial_ulist", "string"], "default": ["string"]}
    rows = scoring.score_documents(pairs, ["id"], None, types, ("exact", "soft")).collect()
    got = {(r.field_name, r.scoring_type, r.scoring_method): (r.tp, r.fp, round(r.score, 6)) for r in rows}
    assert got["tables", "partial_table", "exact"] == (1, 1, 0.5) and got["tables", "table", "exact"] == (0, 1, 0.0) and got["name", "string", "exact"] == (1, 0, 1.0)
    assert got["refs", "partial_list", "exact"] == (0, 1, 1.0) or got["refs", "partial_list", "exact"] == (1, 0, 1.0)
    assert ("refs", "list", "soft") not in got and ("refs", "string", "soft") in got  # items have no such method
    shown = next(r.match_score for r in rows if (r.field_name, r.scoring_type) == ("refs", "list"))
    assert shown.expected == "abc, de"


def test_tables_among_texts(spark):
    """A table type takes texts as tables in JSON, and leaves the other fields alone."""
    table = '{"head": [["h"]], "body": [["1"]]}'
    pairs = spark.createDataFrame([(1, {"tables": [table, "no table"], "title": ["a"]}, {"tables": [table, "no"], "title": ["a"]})], "id int, expected map<string,array<string>>, actual map<string,array<string>>")
    got = {r.field_name: r for r in scoring.score_documents(pairs, ["id"], None, {"tables": ["partial_table"]}, ("exact",)).collect()}
    assert got["tables"].tp == 1 and got["tables"].score == 1.0 and got["title"].tp == 1


def plain_equal(expected, actual, same):
    left, pairs, without = list(actual), [], []
    for x in expected:
        hit = next((i for i, y in enumerate(left) if same(x, y)), None)
        if hit is None:
            without.append(x)
        else:
            pairs.append((x, left.pop(hit), 1.0))
    longest = max(len(without), len(left))
    return pairs + [(x, y, 0.0) for x, y in zip(without + [""] * (longest - len(without)), left + [""] * (longest - len(left)))]


def test_equal_values_out_of_order(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "A", "b", "b ", "é", "", "xx"])
    rows = [([word() for _ in range(rng.randint(0, 9))], [word() for _ in range(rng.randint(0, 9))]) for _ in range(300)] + [([], []), (["a"], []), ([], ["a"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e array<string>, a array<string>")
    got = df.select("i", matching.greedy_equal(F.col("e"), F.col("a")).alias("p"), matching.greedy_equal(F.col("e"), F.col("a"), F.lower).alias("q")).orderBy("i").collect()
    for g, (e, a) in zip(got, rows, strict=True):
        assert [tuple(p) for p in g.p] == plain_equal(e, a, lambda x, y: x == y)
        assert [tuple(p) for p in g.q] == plain_equal(e, a, lambda x, y: x.lower() == y.lower())


def test_many_equal_values(spark):
    rng = random.Random(1)
    values = [f"value {rng.randrange(3000)}" for _ in range(8000)]
    df = spark.createDataFrame([(values, rng.sample(values, 8000))], "e array<string>, a array<string>").cache()
    count = lambda: df.select(F.size(F.filter(matching.greedy_equal(F.col("e"), F.col("a")), lambda p: p["score"] == 1)).alias("n")).first().n
    assert count() == 8000
    began = time.time()
    assert count() == 8000 and time.time() - began < 5


def plain_share(haystack, needles):
    haystack, needles = [x for x in haystack if x], [x for x in needles if x]
    if not haystack or not needles:
        return float(not haystack and not needles)
    text = " ".join(haystack)
    skipped = {len(x) for x in haystack[:-1]}
    covered = {p for x in needles if x in text for p in range(text.index(x), text.index(x) + len(x))}
    return len(covered - skipped) / (len(text) - len(skipped))


def test_items_by_intervals(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(0, 6)))
    rows = [([word() for _ in range(rng.randint(0, 6))], [word() for _ in range(rng.randint(0, 6))]) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e array<string>, a array<string>")
    got = [r.s for r in df.select("i", matching.items_exact(F.col("e"), F.col("a")).alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([plain_share(a, e) if len(e) >= len(a) else plain_share(e, a) for e, a in rows])


def test_command_line_skips_and_counts(spark, tmp_path):
    """A foreign root, a broken file and a table in one list; settings in the section that an evaluation's file has."""
    doc = "<article><front><article-meta><t>{}</t></article-meta></front><body><table-wrap><table><tr><td>1</td></tr></table></table-wrap></body></article>"
    for name, text in {"a": doc.format("One"), "b": "<other/>", "c": "no markup", "d": doc.format("Two")}.items():
        (tmp_path / f"{name}.xml").write_text(text)
    (tmp_path / "f.lst").write_text("a.xml\nb.xml\nc.xml\nd.xml\n")
    (tmp_path / "m.conf").write_text("[article]\ntitle = generic-text-content(front//t)\ntables = (body | back)//table-wrap/table\n")
    (tmp_path / "e.conf").write_text("[scoring_type]\ndefault = list\ntitle = string\ntables = partial_table\n")
    options = f"--target-file-list {tmp_path}/f.lst --prediction-file-list {tmp_path}/f.lst --folder {tmp_path} --xml-mapping {tmp_path}/m.conf --evaluation-config {tmp_path}/e.conf --fields title,tables --measures exact --output-path {tmp_path}/out"
    seen = cli.evaluate(spark, cli.arguments(["evaluate", *options.split()]))
    assert seen == {"file_pairs": 4, "read_error": 0, "documents": 4, "document_error": 2, "fields": 4, "errors": 0}
    got = {r.key: (r.tp, r.fp) for r in files.results(spark, {"x": f"{tmp_path}/out/summary"}).collect() if r.stats_name == "by-field"}
    assert got == {"title:string": ("2", "0"), "tables:partial_table": ("2", "0")}
    with pytest.raises(Exception, match="unrecognised tag|no element|syntax"):
        cli.evaluate(spark, cli.arguments(["evaluate", *options.replace("/out", "/out2").split(), "--no-skip-errors"]))


def test_parser_of_paths():
    tree = paths.parse("(//a[@k='1' or b]/c)[2]/@d")
    assert tree.steps[-1].test == "@d" and tree.base.predicates == (paths.Number(2),)
    assert paths.parse("a | b/c") == paths.Union((paths.parse("a"), paths.parse("b/c")))
