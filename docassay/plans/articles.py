"""Queries on articles in JATS and TEI that are written from `part`, one for each part, and shredded again.

The SQL works out from the table itself what the elements must give, without any XML.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extraction as X
from ..operators import mapping as M
from ..operators import scoring
from ..sources.tables import read, spread

#: {name} stands for a column of `parts`.
JATS = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta>
<title-group><article-title>{name} of
 <italic>{type}</italic></article-title></title-group>
<contrib-group>
<contrib contrib-type="author"><name><surname>{b}</surname><given-names>{ai}. {bi}.</given-names></name><email>{a}@{k}.org</email></contrib>
<contrib contrib-type="editor"><name><surname>{type}</surname><given-names>E.</given-names></name></contrib>
<contrib><string-name>{a} {k}</string-name><xref rid="n{k}"/></contrib>
<contrib contrib-type="author"><collab>{type}</collab></contrib>
</contrib-group>
<aff><label>1</label><city>{type}</city><institution>{brand}</institution></aff>
<aff><label>{k}</label>{brand} in {type}</aff>
<aff><label>2</label><named-content>{type}</named-content></aff>
<author-notes><corresp id="n{k}"><email>{b}@{k}.org</email></corresp></author-notes>
</article-meta></front>
<body><table-wrap><label>T{k}</label><caption>[{name}]</caption><table><thead><tr><th>{a}</th><th>{b}</th></tr></thead>
<tbody><tr><td>{k}</td><td>{size}</td></tr><tr><td>{brand}</td></tr></tbody></table></table-wrap></body>
<back><ref-list><ref><name><surname>{b}</surname><given-names>{ai}</given-names></name><string-name>{a}</string-name>
{own}<ext-link ext-link-type="uri" xlink:href="https://doi.org/10.{k}/link"/><fpage>{page}</fpage><lpage>{size}</lpage></ref>
<ref><ext-link ext-link-type="other" xlink:href="https://doi.org/10.{k}/no"/><fpage>{page}</fpage></ref></ref-list></back></article>"""
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><sourceDesc><biblStruct><analytic>
<author><persName><forename type="first">{ai}.</forename><forename type="middle">{bi}.</forename><surname>{b}</surname></persName>
<affiliation key="aff10"><note type="raw_affiliation"><label>1</label> {brand}</note><note type="raw_affiliation"><label>1</label> in {type}</note><orgName>{type}</orgName></affiliation></author>
<author><persName><surname>{a}</surname></persName><affiliation key="aff10"><orgName>again</orgName></affiliation>
<affiliation key="aff2"><orgName>{type}</orgName><address><settlement>{a}</settlement><country>{b}</country></address></affiliation></author>
<author><email>{a}@{k}.org</email></author>
</analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><div><head>Abstract</head><p>{name}</p><p>{brand}</p></div></abstract></profileDesc></teiHeader>
<text><back><listBibl><biblStruct><analytic><title level="a">{a}</title></analytic><monogr><title level="{level}">{name}</title>
<imprint><biblScope unit="volume">1</biblScope><biblScope unit="page" from="{k}" to="{page}"/></imprint></monogr></biblStruct>
<biblStruct><monogr><title>{name}</title><imprint><biblScope unit="page">{page}</biblScope></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""
#: The same columns for SQL.
PARTS = """p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, p_name AS name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, upper(p_name[1]) AS ai,
 upper(string_split(p_name, ' ')[2][1]) AS bi, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size, CAST(p_partkey + 100 AS VARCHAR) AS page FROM part)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    words = F.split("p_name", " ")
    initial = lambda c: F.upper(F.substring(c, 1, 1))
    even = F.col("p_partkey") % 2 == 0
    made = {
        "k": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "a": words[0], "b": words[1], "ai": initial(words[0]), "bi": initial(words[1]),
        "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size").cast("string"), "page": (F.col("p_partkey") + 100).cast("string"),
        "level": F.when(even, "j").otherwise("m"),
        "own": F.when(even, F.concat(F.lit('<pub-id pub-id-type="doi">10.'), "p_partkey", F.lit("/own</pub-id>"))).otherwise(""),
    }
    return p.select("p_partkey", *(c.alias(n) for n, c in made.items()))


def filled(template: str) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def shredded(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    return X.shred(parts(spark, sf_dir).select("p_partkey", filled(template).alias("xml")), "xml", ["p_partkey"])


def _joined(xs: Column, sep: str = "|") -> Column:
    return F.array_join(X.without_nulls(xs), sep)


def jats_people(spark, sf_dir):
    """Authors, their addresses and affiliations; editors and groups without a name aren't among the names."""
    authors = X.jats_authors()
    name = X.select("//contrib/name")
    columns = {
        "n_authors": F.size(authors).cast("long"),
        "given_names": _joined(F.transform(authors, X.jats_given_name)),
        "full_names": _joined(F.transform(authors, X.jats_full_name)),
        "emails": _joined(F.transform(authors, X.jats_author_email)),
        "affiliations": _joined(F.transform(X.select("//aff"), X.jats_affiliation)),
        "concatenated": _joined(F.transform(name, lambda n: X.concat_children(n, "$given-names", "/", "$surname"))),
        "ordered": _joined(F.transform(name, lambda n: X.join_children(n, "surname||given-names", ", "))),
    }
    return shredded(spark, sf_dir, JATS).select("p_partkey", *(c.alias(n) for n, c in columns.items()))


def jats_fields(spark, sf_dir):
    """Fields by a mapping, of which one ignores an element, references, and a table with what surrounds it."""
    mapping = {"title": "/article/front//article-title", "title.ignore": "//article-title/italic", "notes": "//corresp[@id]/email", "editors": "//contrib[@contrib-type='editor']//surname"}
    made = X.with_fields(shredded(spark, sf_dir, JATS), mapping)
    refs = X.select("//ref")
    wrap = F.transform(X.select("//table-wrap"), X.table_wrap)
    cells = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), ";")
    columns = {
        "title": F.get("title", F.lit(0)),
        "whole_title": _joined(F.transform(X.select("//article-title"), X.normalized_text)),
        "notes": _joined(F.col("notes")),
        "editors": _joined(F.col("editors")),
        "ref_authors": _joined(F.flatten(F.transform(refs, lambda r: F.transform(X.jats_ref_authors(r), X.jats_full_name)))),
        "dois": _joined(F.transform(refs, X.jats_ref_doi)),
        "first_pages": _joined(F.transform(refs, lambda r: X.jats_ref_pages(r)[0])),
        "last_pages": _joined(F.transform(refs, lambda r: F.coalesce(X.jats_ref_pages(r)[1], F.lit("")))),
        "label": _joined(F.transform(wrap, lambda w: w["label"])),
        "caption": _joined(F.transform(wrap, lambda w: X.strip_brackets(w["caption"]))),
        "head": _joined(F.transform(wrap, lambda w: cells(w["table"]["head"]))),
        "body": _joined(F.transform(wrap, lambda w: cells(w["table"]["body"]))),
        "all_rows": _joined(F.transform(X.select("//table"), lambda t: cells(X.table_rows(t)))),
        "cells": _joined(F.transform(X.select("//table"), lambda t: F.array_join(X.items(t, "tr|th|td"), ","))),
    }
    return made.select("p_partkey", *(c.alias(n) for n, c in columns.items()))


def tei_fields(spark, sf_dir):
    """Authors, affiliations in natural order of their keys, references and the abstract."""
    authors, affiliations = X.tei_authors(), X.tei_author_affiliations()
    refs = X.select("//listBibl/biblStruct")
    columns = {
        "given_names": _joined(F.transform(authors, X.tei_given_name)),
        "full_names": _joined(F.transform(authors, X.tei_full_name)),
        "affiliations": _joined(X.tei_affiliations(affiliations)),
        "affiliation_texts": _joined(X.tei_affiliation_texts(affiliations)),
        "by_label": _joined(X.tei_affiliations_by_label(affiliations)),
        "first_pages": _joined(F.transform(refs, lambda r: X.tei_ref_pages(r)[0])),
        "last_pages": _joined(F.transform(refs, lambda r: X.tei_ref_pages(r)[1])),
        "kinds": _joined(F.transform(refs, X.tei_ref_publication_type)),
        "abstract": _joined(F.transform(X.select("//abstract"), X.tei_abstract)),
    }
    return shredded(spark, sf_dir, TEI).select("p_partkey", *(c.alias(n) for n, c in columns.items()))


def list_functions(spark, sf_dir):
    """Nested lists normalised, and a text split with the offsets of its pieces."""
    p = parts(spark, sf_dir)
    nested = F.array(F.array(F.concat("name", F.lit(" \n "), "brand"), F.col("type")), F.array(F.upper("name")))
    rows = F.transform(text.normalize_list(nested, lower=True, nested=True), lambda r: F.array_join(r, ","))
    pieces = text.split_with_index(F.concat("name", F.lit("\n"), "brand", F.lit("\n\n"), "type"), "\n")
    said = F.transform(pieces, lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["piece"]))
    return p.select("p_partkey", F.array_join(rows, ";").alias("normalized"), F.array_join(said, ";").alias("pieces"))


#: A mapping with calls, filter expressions, places, attributes and texts, as the INI file of an evaluation has them.
MAPPING = {
    "article": {
        "first_surname": "jats-authors(.)[1]/name/surname",
        "typed_surnames": "jats-authors(.)[@contrib-type=\"author\"]/name/surname",
        "full_names": "jats-full-name(jats-authors(.))",
        "last_full_name": "jats-full-name(jats-authors(.)[name or string-name][last()])",
        "emails": "jats-author-email(jats-authors(.))",
        "fields": "generic-as-items(back//ref, './/*')",
        "names": "generic-as-items(back//ref, 'jats-full-name(jats-ref-authors(.))')",
        "pages": "generic-join-children((back//ref)[1], './/lpage || .//fpage', '-')",
        "first_pages": "jats-ref-fpage(back//ref)",
        "link_types": "(back//ref)/ext-link/@ext-link-type",
        "hosts": "back//ref[1]/ext-link/@xlink:href",
        "labels": "front//aff[city]/label | front//aff[not(city)]/label",
        "last_label": "front//aff[last()]/label",
        "parts": "generic-join-children(front//aff[1], './/*[self::city or self::institution]', ', ')",
        "notes": "front//author-notes/corresp/email/text()",
        "caption": "generic-strip-brackets((body | back)//table-wrap/caption)",
        "title": "front/article-meta/title-group/article-title",
        "title.ignore": ".//italic",
        "tables": "(body | back)//table-wrap/table",
        "wraps": "body/table-wrap",
    },
    "namespaces": {"xlink": "http://www.w3.org/1999/xlink"},
}


def mapped_fields(spark, sf_dir):
    """Fields by a mapping whose values call functions; each field's values side by side."""
    made = M.with_fields(shredded(spark, sf_dir, JATS), MAPPING)
    names = [f for f in MAPPING["article"] if ".ignore" not in f]
    # every field once, in one array, so that the map isn't searched for each
    said = F.transform(F.map_values("fields"), lambda vs: F.array_join(F.transform(vs, lambda v: F.when(v["kind"] == "items", F.array_join(v["items"], ",")).otherwise(M.texts(F.array(v))[0])), "|"))
    return made.select("p_partkey", said.alias("said")).select("p_partkey", *(F.get("said", F.lit(i)).alias(f) for i, f in enumerate(names)))


def mapped_scores(spark, sf_dir):
    """Typed fields of articles against those of a copy in which every third has another cell and page: tables, items and texts under their types."""
    third = F.col("p_partkey") % 3 == 0
    changed = JATS.replace("{size}", "{other}")
    p = parts(spark, sf_dir).withColumn("other", F.when(third, "none").otherwise(F.col("size")))
    kinds = {"tables": "(body | back)//table-wrap/table", "fields": "generic-as-items(back//ref, './/*')", "pages": "jats-ref-lpage(back//ref)"}
    sides = p.select("p_partkey", filled(JATS).alias("xml"), filled(changed).alias("other_xml"))
    made = M.with_fields(X.shred(sides, "xml", ["p_partkey", "other_xml"]), {"article": kinds}).select("p_partkey", "other_xml", F.col("fields").alias("expected"))
    made = M.with_fields(X.shred(made, "other_xml", ["p_partkey", "expected"]), {"article": kinds}).select("p_partkey", "expected", F.col("fields").alias("actual"))
    types = {"tables": ["partial_table", "table"], "fields": ["partial_list"], "pages": ["partial_set", "list"]}
    scored = scoring.score_documents(made, ["p_partkey"], None, types, ["exact"])
    return scored.select("p_partkey", "field_name", "scoring_type", "tp", "fp", "fn", "tn", F.round("score", 9).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (jats_people, jats_fields, tei_fields, mapped_fields, mapped_scores, list_functions)}


def oracle_sql() -> dict[str, str]:
    return {
        "jats_people": f"""WITH {PARTS} SELECT p_partkey, CAST(3 AS BIGINT) AS n_authors, ai || bi AS given_names, ai || bi || ' ' || b || '|' || a || ' ' || k AS full_names, a || '@' || k || '.org|' || b || '@' || k || '.org' AS emails,
 brand || ', ' || type || '|' || k || ' ' || brand || ' in ' || type || '|' || type AS affiliations, ai || '. ' || bi || './' || b || '|E./' || type AS concatenated, b || ', ' || ai || '. ' || bi || '.|' || type || ', E.' AS ordered FROM p""",
        "jats_fields": f"""WITH {PARTS} SELECT p_partkey, name || ' of' AS title, name || ' of ' || type AS whole_title, b || '@' || k || '.org' AS notes, type AS editors, ai || ' ' || b || '|' || a AS ref_authors,
 CASE WHEN p_partkey % 2 = 0 THEN '10.' || k || '/own|' ELSE '10.' || k || '/link|' END AS dois, page || '|' || page AS first_pages,
 CASE WHEN length(page) > length(size) THEN substr(page, 1, length(page) - length(size)) || size ELSE size END || '|' || page AS last_pages, 'T' || k AS label, name AS caption, a || ',' || b AS head,
 k || ',' || size || ';' || brand AS body, a || ',' || b || ';' || k || ',' || size || ';' || brand AS all_rows, a || ',' || b || ',' || k || ',' || size || ',' || brand AS cells FROM p""",
        "tei_fields": f"""WITH {PARTS} SELECT p_partkey, ai || bi || '|' AS given_names, ai || bi || ' ' || b || '|' || a AS full_names, type || ', ' || a || ', ' || b || '|1 ' || brand || ', 1 in ' || type AS affiliations, '|1 ' || brand || ', 1 in ' || type AS affiliation_texts,
 '1 ' || brand || ' in ' || type AS by_label, k || '|' || page AS first_pages, page || '|' || page AS last_pages, CASE WHEN p_partkey % 2 = 0 THEN 'journal' ELSE 'book' END || '|' || page AS kinds, name || ' ' || brand AS abstract FROM p""",
        "mapped_fields": f"""WITH {PARTS} SELECT p_partkey, b AS first_surname, b AS typed_surnames, ai || bi || ' ' || b || '|' || a || ' ' || k AS full_names, a || ' ' || k AS last_full_name, a || '@' || k || '.org|' || b || '@' || k || '.org' AS emails,
 b || ',' || ai || ',' || a || CASE WHEN p_partkey % 2 = 0 THEN ',10.' || k || '/own' ELSE '' END || ',,' || page || ',' || size || '|,' || page AS fields, ai || ' ' || b || ',' || a || '|' AS names, size || '-' || page AS pages,
 page || '|' || page AS first_pages, 'uri|other' AS link_types, 'https://doi.org/10.' || k || '/link' AS hosts, '1|' || k || '|2' AS labels, '2' AS last_label, type || ', ' || brand AS parts, b || '@' || k || '.org' AS notes,
 name AS caption, name || ' of' AS title, a || ' ' || b || ' ' || k || ' ' || size || ' ' || brand AS tables, 'T' || k || ' [' || name || '] ' || a || ' ' || b || ' ' || k || ' ' || size || ' ' || brand AS wraps FROM p""",
        "mapped_scores": f"""WITH {PARTS}, s AS (SELECT p_partkey, p_partkey % 3 <> 0 AS same,
  b || ' ' || ai || ' ' || a || CASE WHEN p_partkey % 2 = 0 THEN ' 10.' || k || '/own' ELSE '' END || ' ' || page || ' ' AS lead, size, page,
  [b, ai, a] || CASE WHEN p_partkey % 2 = 0 THEN ['10.' || k || '/own'] ELSE [] END || [page] AS items,
  CASE WHEN length(page) > length(size) THEN substr(page, 1, length(page) - length(size)) || size ELSE size END AS last FROM p),
 t AS (SELECT *, items || [CASE WHEN same THEN size ELSE 'none' END] AS h, items || [size] AS n, CASE WHEN length(page) > 4 AND NOT same THEN substr(page, 1, length(page) - 4) || 'none' WHEN NOT same THEN 'none' ELSE last END AS other FROM s),
 found AS (SELECT p_partkey, instr(text, x) AS place, length(x) AS size FROM (SELECT p_partkey, array_to_string(h, ' ') AS text, unnest(n) AS x FROM t) WHERE contains(text, x)),
 skipped AS (SELECT DISTINCT p_partkey, length(x) + 1 AS p FROM (SELECT p_partkey, unnest(h[1:len(h) - 1]) AS x FROM t)),
 covered AS (SELECT p_partkey, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(range(place, place + size)) AS p FROM found) ANTI JOIN skipped USING (p_partkey, p) GROUP BY p_partkey),
 lost AS (SELECT p_partkey, count(*) AS n FROM skipped GROUP BY p_partkey),
 share AS (SELECT p_partkey, covered.n / (length(array_to_string(h, ' ')) - lost.n) AS x FROM t JOIN covered USING (p_partkey) JOIN lost USING (p_partkey)),
 r AS (SELECT p_partkey, 'tables' AS field_name, 'partial_table' AS scoring_type, same AS tp, NOT same AS fp, CAST(same AS DOUBLE) AS score FROM t
 UNION ALL SELECT p_partkey, 'tables', 'table', same, NOT same, CAST(same AS DOUBLE) FROM t
 UNION ALL SELECT p_partkey, 'pages', 'list', last = other, last <> other, CAST(last = other AS DOUBLE) FROM t),
 q AS (SELECT p_partkey, 'fields' AS field_name, 'partial_list' AS scoring_type, CAST(x >= 1 AS BIGINT) + 1 AS tp, CAST(x < 1 AS BIGINT) AS fp, (x + 1) / 2 AS score FROM share
 UNION ALL SELECT p_partkey, 'pages', 'partial_set', CASE WHEN last = other THEN len(list_distinct([last, page])) WHEN last = page OR other = page THEN 1 ELSE 1 END,
  CASE WHEN last = other THEN 0 ELSE 1 END, CASE WHEN last = other THEN 1.0 ELSE 0.5 END FROM t)
 SELECT p_partkey, field_name, scoring_type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(0 AS BIGINT) AS tn, round(score, 9) AS score FROM r
 UNION ALL SELECT p_partkey, field_name, scoring_type, CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), round(score, 9) FROM q""",
        "list_functions": f"""WITH {PARTS} SELECT p_partkey, lower(name) || ' ' || lower(brand) || ',' || lower(type) || ';' || lower(name) AS normalized, '0:' || name || ';' || (length(name) + 1) || ':' || brand || ';' || (length(name) + length(brand) + 3) || ':' || type AS pieces FROM p""",
    }
