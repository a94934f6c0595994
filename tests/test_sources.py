"""Extraction from XML and HTML, file lists, settings, tables and the report."""

import gzip
import xml.etree.ElementTree as ET

import duckdb
import pytest
from pyspark.sql import functions as F

from docassay.operators import details, extraction as X, mapping as M, summary
from docassay.plans import registry
from docassay.sources import config, files

ARTICLE = """<article xmlns="urn:x" xmlns:l="urn:l"><front><article-title>On <i>things</i></article-title><article-meta>
<contrib-group><contrib contrib-type="author"><name><surname>Reed</surname><given-names>A. B.</given-names></name><xref rid="n1"/></contrib>
<contrib><string-name>Jo Doe</string-name><email>jo@x.org</email></contrib><contrib contrib-type="editor"><name><surname>No</surname></name></contrib><contrib><collab>All</collab></contrib></contrib-group>
<author-notes><corresp id="n1"><email>reed@x.org</email></corresp></author-notes></article-meta><aff id="a1"><label>1</label>Some place , here</aff>
<aff id="a1"><label>2</label><institution>Uni</institution><city>Town</city></aff><aff>Dept <institution>Uni</institution>, <city>Town</city></aff><aff><label>3</label><x>Only</x></aff></front>
<back><ref><name><surname>In</surname></name><fpage>123</fpage><lpage>7</lpage><ext-link l:href="https://doi.org/10.3/no">x</ext-link><ext-link ext-link-type="uri" l:href="https://doi.org/10.1/x">x</ext-link></ref>
<ref><string-name>Two</string-name><name><surname>One</surname></name><pub-id pub-id-type="doi">10.2/y</pub-id><fpage>5</fpage></ref><ref/></back>
<table-wrap><label>T1</label><table><thead><tr><th>h</th></tr></thead><tbody><tr><th>no</th><td>1</td><td>2<table><tr><td>in</td></tr></table></td></tr></tbody></table></table-wrap></article>"""


def test_fields_of_xml(spark):
    docs = spark.createDataFrame([(1, ARTICLE), (2, "no markup"), (3, None)], "id int, xml string")
    made = X.shred(docs, "xml", ["id"]).orderBy("id").cache()
    assert [r.error is not None for r in made.collect()] == [False, True, False]
    every = lambda path, f: F.transform(X.select(path), f)
    authors = lambda f: X.without_nulls(F.transform(X.jats_authors(), f))
    row = made.select(
        X.texts("//article-title").alias("title"),
        authors(X.jats_full_name).alias("names"),
        authors(X.jats_given_name).alias("given"),
        authors(X.jats_author_email).alias("mails"),
        every("//ref", lambda n: F.transform(X.jats_ref_authors(n), X.raw)).alias("ref_authors"),
        every("//aff", X.jats_affiliation).alias("affs"),
        every("//ref", X.jats_ref_doi).alias("dois"),
        every("//ref", lambda n: X.jats_ref_pages(n)[1]).alias("last"),
        F.size(X.first_by_attribute(X.select("//aff"), "id")).alias("n_affs"),
        every("//table-wrap", X.table_wrap).alias("wraps"),
        every("//table-wrap/table", X.table_rows).alias("rows"),
        X.attributes("/article/front/aff[@id='a1']", "id").alias("ids"),
        every("//front", lambda n: X.items(n, "name|surname|contrib")).alias("items"),
        every("//name", lambda n: X.concat_children(n, "$given-names", "-", "$surname", "$none")).alias("concat"),
        every("//ref[1]", lambda n: X.join_children(n, "lpage||.//fpage", "+")).alias("join"),
        X.texts("//contrib[not(@contrib-type)]/string-name | //contrib[@contrib-type='editor' or @contrib-type='x'][name]/name").alias("tests"),
        X.texts("//ext-link[not(contains(@ext-link-type,'ur'))]").alias("no_uri"),
        F.array(*(X.strip_brackets(F.lit(x)) for x in ("[ 1 ]", "[a\nb]", "(x]", ""))).alias("bare"),
    ).first()
    assert row.title == ["On things"] and row.names == ["AB Reed", "Jo Doe"] and row.given == ["AB"] and row.mails == ["reed@x.org", "jo@x.org"]
    assert row.ref_authors == [["In"], ["One", "Two"], []]
    assert row.affs == ["1 Some place, here", "Uni, Town", "Dept Uni, Town", "Only"] and row.dois == ["10.1/x", "10.2/y", ""] and row["last"] == ["127", "5", ""]
    assert row.n_affs == 3 and row.ids == ["a1", "a1"] and row["items"] == [["Reed", "Jo Doejo@x.org", "No", "All"]]
    (wrap,) = row.wraps
    assert (wrap.label, wrap.caption, wrap.table.head, wrap.table.body) == ("T1", "", [["h"]], [["1", "2in"]]) and row.rows == [[["h"], ["1", "2in"]]]
    assert row.concat == ["A. B.-Reed", "-No", "-In", "-One"] and row.join == ["7+123"] and row.tests == ["Jo Doe", "No"] and row.no_uri == ["x"]
    assert row.bare == ["1", "a\nb", "(x]", ""]
    assert X.with_fields(made, {"t": "//article-title", "t.ignore": "//i"}, ["t"]).first().t == ["On"]
    mapped = M.with_fields(made, {"article": {"t": "//article-title", "n": "front//fpage | .//fpage"}, "tei": {"t": "//x"}}).first()
    assert {f: [v.text for v in vs] for f, vs in mapped.fields.items()} == {"t": ["On things"], "n": ["123", "5"]} and mapped.error is None
    other = M.with_fields(made, {"tei": {"t": "//x"}})
    assert other.first().error == "unrecognised tag: article"


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><sourceDesc><biblStruct><analytic>
<author><persName><forename>A.</forename><forename>B.</forename><surname>Reed</surname></persName><affiliation key="a10"><note type="raw_affiliation"><label>2</label> Two</note><orgName>x</orgName></affiliation></author>
<author><persName><surname>Doe</surname></persName><affiliation key="a2"><note type="raw_affiliation"><label>1</label> One</note></affiliation><affiliation key="a2"><orgName>y</orgName></affiliation></author>
<author><affiliation key="a3"><note type="raw_affiliation"><label>1</label> more</note></affiliation><affiliation key=""><orgName>Org</orgName><address><country>C</country><addrLine>L</addrLine></address></affiliation>
<affiliation key=""><note type="raw_affiliation">Bare</note></affiliation></author></analytic></biblStruct></sourceDesc></fileDesc></teiHeader>
<abstract><div><head>Abstract</head><p>One <i>two</i></p></div></abstract><abstract>plain</abstract>
<bibl><title level="j">J</title><biblScope unit="page" from="10" to="12"/></bibl><bibl><title level="m">M</title><biblScope unit="page">33</biblScope></bibl><bibl><biblScope unit="page">7</biblScope></bibl></TEI>"""


def test_fields_of_tei(spark):
    made = X.shred(spark.createDataFrame([(1, TEI)], "id int, xml string"), "xml", ["id"])
    every = lambda path, f: F.transform(X.select(path), f)
    authors = lambda f: X.without_nulls(F.transform(X.tei_authors(), f))
    affs = X.tei_author_affiliations()
    row = made.select(
        authors(X.tei_given_name).alias("given"), authors(X.tei_full_name).alias("names"), X.tei_affiliations(affs).alias("affs"), X.tei_affiliation_texts(affs).alias("texts"),
        X.tei_affiliations_by_label(affs).alias("labels"), every("//abstract", X.tei_abstract).alias("abstracts"), every("//bibl", lambda n: X.tei_ref_pages(n)[0]).alias("first"),
        every("//bibl", lambda n: X.tei_ref_pages(n)[1]).alias("last"), every("//bibl", X.tei_ref_publication_type).alias("kinds"),
    ).first()
    assert row.given == ["AB", ""] and row.names == ["AB Reed", "Doe"]
    assert row.affs == ["Org, L, C", "Bare", "1 One", "1 more", "2 Two"] and row.texts == ["", "Bare", "1 One", "1 more", "2 Two"]
    assert row.labels == ["Bare", "1 One more", "2 Two"] and row.abstracts == ["One two two", "plain"]
    assert row.first == ["10", "33", "7"] and row["last"] == ["12", "33", "7"] and row.kinds == ["journal", "book", "7"]


def test_recovered_xml(spark):
    broken = ["<a><b>x&nbsp;y</b><C k='1' k='2'>z", "<a><p>one</q><br/>two &amp; <![CDATA[<3>]]></a> tail", "<a:r xmlns:a='u'><a:Title>t</a:Title><i>u</a:r>"]
    made = X.shred(spark.createDataFrame(list(enumerate(broken)), "id int, xml string"), "xml", ["id"]).orderBy("id")
    rows = made.select("content", F.transform("nodes", lambda n: n["path"]).alias("paths"), X.attributes("//C", "k").alias("k"), "error").collect()
    assert [r.content for r in rows] == ["x\u00a0yz", "onetwo & <3>", "tu"] and rows[0].k == ["1"] and not any(r.error for r in rows)
    assert [r.paths for r in rows] == [["/a", "/a/b", "/a/C"], ["/a", "/a/p", "/a/p/br"], ["/r", "/r/Title", "/r/i"]]


def test_fields_of_html(spark):
    docs = spark.createDataFrame([(1, "<html><body><p>a<br>b<p>c</p></div></body>")], "id int, html string")
    row = X.shred(docs, "html", ["id"], html=True).select(X.texts("//p").alias("p"), X.texts("/html/body").alias("b")).first()
    assert row.b == ["abc"] and row.p == ["abc", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"<a/>")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(b"<b/>"))
    (tmp_path / "t.tsv").write_text("url\tx\na.xml\t1\nb.xml.gz\t2\n")
    (tmp_path / "p.txt").write_text("b.xml.gz\na.xml\n")
    one, two = files.file_list(spark, f"{tmp_path}/t.tsv"), files.file_list(spark, f"{tmp_path}/p.txt")
    pairs = files.with_content(files.file_pairs(one, two), files.contents(spark, str(tmp_path), "*.xml*"))
    got = pairs.orderBy("pos").select("target_content", "prediction_content").collect()
    assert [(bytes(r[0]), bytes(r[1])) for r in got] == [(b"<a/>", b"<b/>"), (b"<b/>", b"<a/>")]
    assert files.file_list(spark, f"{tmp_path}/t.tsv", limit=1).count() == 1
    with pytest.raises(ValueError):
        files.file_pairs(one, two.where("pos = 0"))


def test_only_listed_files_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "AT_ONCE", 2)
    for n in range(6):
        (tmp_path / f"{n}.xml").write_text(f"<a>{n}</a>")
    (tmp_path / "broken.gz").write_bytes(b"\x1f\x8bno")
    asked = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("1.xml", "3.xml", "3.xml", "5.xml", "none.xml", "broken.gz")], "path string")
    rows = files.listed(spark, str(tmp_path), asked).collect()
    assert sorted((r.path.rpartition("/")[2], bytes(r.content or b"")) for r in rows) == [("1.xml", b"<a>1</a>"), ("3.xml", b"<a>3</a>"), ("5.xml", b"<a>5</a>"), ("broken.gz", b"")]
    assert [bool(r.error) for r in rows if r.path.endswith("gz")] == [True]
    assert files.listed(spark, str(tmp_path), asked.where("path LIKE '%none%'")).count() == 0


def test_positions(spark):
    rows = files.positions(spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id")).where("id <> pos").count()
    assert rows == 0


def test_settings():
    assert config.ini("[a]\nKey = //x[@y]\n") == {"a": {"Key": "//x[@y]"}}
    assert config.field_list("a,b") == ["a", "b"] and config.field_list("+c,d,-a", ["a", "b"]) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        config.field_list("-x", ["a"])
    assert config.overrides("f=list,set|g=string") == {"f": ["list", "set"], "g": ["string"]}
    assert config.scoring_types({"default": "list"}, {"f": ["set"]}, "f") == ["set"] and config.scoring_types({"default": "list"}, {}, "g") == ["list"]
    custom = [{"name": "c", "expected": {"field_names": ["x"]}, "actual": {"field_names": ["y", "x"]}}]
    assert config.source_fields(["a", "c"], custom) == ["a", "c", "x", "y"] and config.custom_fields({}) == []


def test_tables_and_report(spark, tmp_path):
    scored = spark.createDataFrame([("exact", "title", 6, 4, 0), ("exact", "abstract", 1, 0, 0)], "scoring_method string, field_name string, tp long, fp long, fn long")
    made = details.flatten_summary(summary.summary(scored), 10, "string")
    files.write_summary(made, f"{tmp_path}/s")
    back = files.results(spark, {"one": f"{tmp_path}/s", "two": f"{tmp_path}/s"})
    assert back.count() == 8 and back.where("stats_name = 'micro' AND field_name IS NULL").count() == 2
    assert {r.key for r in back.select("key").collect()} >= {"title:string"}
    text = files.report_text(summary.summary(scored), ["title", "abstract"]).split("\n")
    assert text[:5] == ["", f"  {files.HEADINGS['exact']}", "", "  ===== Field-level results =====", ""] and files.report_text(scored.limit(0).withColumn("stats_name", F.lit("")).withColumns({m: F.lit(0.0) for m in files.METRICS})) == ""
    with pytest.raises(ValueError):
        files.report_text(summary.summary(scored).withColumn("scoring_method", F.lit("vague")))
    assert text[5] == "  " + " ".join(x.rjust(w) for x, w in zip(["label", *files.METRICS], files.WIDTHS))
    assert [x.split()[0] for x in text[7:9]] == ["title", "abstract"] and text[-2].split()[:2] == ["all", "fields"] and text[-1].endswith("(macro average)")


def test_details_written_and_read(spark, tmp_path):
    rows = [("p", "t", "f", "exact", "list", 1, 0, 0, 0, 'say "x", y', "two\nlines", None, None), ("p", "t", "g", "exact", "list", 0, 0, 1, 0, "", "é", "a", "b")]
    kinds = ", ".join(f"{c} {'long' if c in ('tp', 'fp', 'fn', 'tn') else 'string'}" for c in details.DETAILS)
    files.write_details(spark.createDataFrame(rows, kinds), f"{tmp_path}/d")
    back = {r.field_name: r for r in files.results(spark, {"one": f"{tmp_path}/d"}).collect()}
    assert (back["f"].expected, back["f"].actual, back["f"].expected_context, back["f"].tp) == ('say "x", y', "two\nlines", None, "1")
    assert (back["g"].expected or "", back["g"].actual, back["g"].key) == ("", "é", "g:list")


def test_command_line(spark, tmp_path, capsys):
    from docassay import __main__ as cli

    for name, title, people in (("a", "One", "X|Y"), ("b", "Two", "Z"), ("pa", "one", "Y|X"), ("pb", "Two", "Z")):
        (tmp_path / f"{name}.xml").write_text(f"<article><t>{title}</t>{''.join(f'<p>{x}</p>' for x in people.split('|'))}<bb>1,0,0,2,2</bb></article>")
    (tmp_path / "t.lst").write_text("a.xml\nb.xml\nnone.xml\n")
    (tmp_path / "p.lst").write_text("pa.xml\npb.xml\npb.xml\n")
    (tmp_path / "m.conf").write_text("[article]\ntitle = //t\nauthor_surnames = //p\nbox = //bb\n")
    (tmp_path / "e.conf").write_text("[scoring_types]\ndefault = string\nauthor_surnames = partial_set\n")
    (tmp_path / "c.json").write_text('{"custom": {"fields": [{"name": "boxes", "type": "bounding_box_intersection_area", "expected": {"field_names": ["box"]}, "actual": {"field_names": ["box"]}}]}}')
    options = f"--target-file-list {tmp_path}/t.lst --prediction-file-list {tmp_path}/p.lst --folder {tmp_path} --xml-mapping {tmp_path}/m.conf --evaluation-config {tmp_path}/e.conf --evaluation-yaml-config {tmp_path}/c.json --fields title,author_surnames --measures exact,soft --output-path {tmp_path}/out"
    seen = cli.evaluate(spark, cli.arguments(["evaluate", *options.split()]))
    assert seen == {"file_pairs": 3, "read_error": 1, "documents": 2, "document_error": 0, "fields": 4, "errors": 0}
    rows = files.results(spark, {"x": f"{tmp_path}/out/summary"}).collect()
    got = {(r.key, r.evaluation_method): r.tp for r in rows if r.stats_name == "by-field"}
    assert got["title:string", "exact"] == "1" and got["author_surnames:partial_set", "exact"] == "3" and {r.document_count for r in rows} == {"2"}
    assert "all fields" in "".join(r.value for r in spark.read.text(f"{tmp_path}/out/report").collect())
    cli.main(["extract", "--xml-file", f"{tmp_path}/a.xml", "--xml-mapping", f"{tmp_path}/m.conf", "--fields", "title"])
    assert '"title"' in capsys.readouterr().out


def test_details(spark):
    s = "struct<tp:long,fp:long,fn:long,tn:long,expected:string,actual:string>"
    rows = [("x/p", "y/t", "f", "exact", "list", [], (1, 0, 0, 0, "a", "a")), ("x/q", "y/t", "f", "exact", "string", None, (0, 1, 0, 0, "a", "b"))]
    df = spark.createDataFrame(rows, f"prediction_file string, target_file string, field_name string, scoring_method string, scoring_type string, sub_scores array<{s}>, match_score {s}")
    got = details.flatten_details(df, ["f"]).collect()
    assert [(r.prediction_file, r.fp, r.expected_context) for r in got] == [("q", 1, None)]


def test_paths_against_a_plain_parser(spark):
    """Paths with predicates on any step find what the standard library's parser finds."""
    source = """<r><a k="1"><b><c>1</c><a k="2"><c>2</c></a></b></a><a><b k="1"><c>3</c><d><c>4</c></d></b></a><b><a k="1"><d><c>5</c></d></a></b><c>6</c></r>"""
    paths = ["//a[@k='1']//c", "//a[@k]//b//c", "//b[@k='1']/d//c", "//a[@k='2']/c", "//b[d]//c", "//a[@k='1']/b/a//c", "/r/a[2]//c", "//a[@k='1']//d/c", "//b//a[@k]//c"]
    made = X.shred(spark.createDataFrame([(1, source)], "id int, xml string"), "xml", ["id"])
    got = made.select(*(X.texts(p).alias(str(i)) for i, p in enumerate(paths))).first()
    root = ET.fromstring(source)
    for i, p in enumerate(paths):
        assert sorted(got[i]) == sorted(e.text for e in root.findall("." + p.removeprefix("/r") if p.startswith("/r/") else "." + p)), p
    below = made.select(F.transform(X.select("/r/a"), lambda n: F.transform(X.relative(n, "b[@k]//c"), X.value)).alias("x")).first().x
    assert below == [[], ["3", "4"]]


def test_references_of_given_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "<title>a&amp</title><p>&lt;&ampx; &copy;&#65;</p><a href='?x=1&lt=2&amp;y'>\ufdd0&gt</a>")], "id int, html string")
    row = X.shred(docs, "html", ["id"], html=True, names=("amp", "lt")).select("content", X.attributes("//a", "href").alias("h")).first()
    assert row.content == "a&amp<&ampx; &copy;&#65;\ufdd0&gt" and row.h == ["?x=1&lt=2&y"]
    row = X.shred(docs, "html", ["id"], html=True).select("content").first()
    assert row.content == "a&<&x; \u00a9A\ufdd0>"
    # the query gives what its SQL gives
    page = "<html><head><title>x &quot;y&quot; &amp;&amp</title></head><body><h1>&#x27;a&#x27; &lt;b&gt;</h1><a href=\"/u\">u</a></body></html>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = duck.sql(registry.oracle_sql()["page_fields_json"]).fetchall()
    assert [tuple(r) for r in registry.queries()["page_fields_json"](spark, str(tmp_path)).collect()] == want
