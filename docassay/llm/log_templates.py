"""Line dedup by a log-template tree, with DataFrame functions only.

Tokens with a digit are variable fields and count as <*>. The tree has a fixed depth: a line goes to a leaf by its
number of tokens, then by its first LEAD tokens. A leaf holds several templates: behind the leading ones, most of a
line's tokens are at least as frequent, at their place among the leaf's different lines, as some number m, and those
of half of m or less are fields too. So lines of a template agree in most places, and others don't undo them. A
template recurs if it stands in at least `documents` documents, whole copies of one text being one document: so the
lines of a document that was merely copied don't recur. Of a recurring template the earliest line stays (least doc_id, then
place); the others are dropped.

Edge cases: a null text stays null and has no lines; blank lines are no templates and stay; rows that repeat
doc_id and text are one document; rows that repeat only doc_id are told apart by text; an empty table gives an
empty one. `text` is replaced, `n_dropped` and `dropped` replace columns of those names, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_heat, discard, let, small, stored, text_key, unused, without

#: Leading tokens on the way to a leaf; share of a line's tokens behind those that says how frequent its template is; different texts that make it recur.
LEAD, AGREE, DOCUMENTS = 3, 0.6, 8
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens, those with a digit as <*>, with single spaces between."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\f") | line.contains("\v")
    line = F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*", FIELD)).otherwise(line)


def digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def n_tokens(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column) -> Column:
    """The path in the tree: number of tokens and leading tokens."""
    return F.xxhash64(n_tokens(line), F.substring_index(line, " ", LEAD))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, at, line): lines that aren't blank, masked."""
    every = let(F.split("text", "\n"), lambda ls: F.transform(ls, masked))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.posexplode(every).alias("at", "line"))
    return rows.where(F.col("line") != "")


def generalised(rows: DataFrame, different: DataFrame) -> DataFrame:
    """(template, whole): the digests of lines of rows (leaf, line) that have rare tokens at their places, and of them with these masked."""
    mixed = stored(different.where(F.col("tokens") > LEAD).groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf"))
    texts = rows.where(F.col("tokens") > LEAD).select("leaf", "line").join(small(mixed), "leaf", "leftsemi").distinct()
    split = texts.select("leaf", digest(F.col("line")).alias("template"), F.substring_index("line", " ", LEAD).alias("lead"), F.posexplode(F.split("line", " ")).alias("at", "token")).where(F.col("at") >= LEAD)
    # The leading tokens travel once a line, with its first place.
    places = stored(split.select("template", F.when(F.col("at") == LEAD, F.col("lead")).alias("lead"), "at", "token", F.xxhash64("leaf", "at", "token").alias("place")))
    facts = stored(places.groupBy("place").agg(F.count("*").alias("c")).withColumn("n", F.col("c")))
    counted = by_heat(places, facts, "place", "n", places.count())
    each = counted.groupBy("template").agg(F.max("lead").alias("lead"), F.sort_array(F.collect_list(F.struct("at", "token", "c"))).alias("ts"))
    ranked = F.sort_array(F.transform("ts", lambda t: t["c"]), asc=False)
    m = F.get(ranked, F.ceil(F.size("ts") * AGREE).cast("int") - 1)
    said = let(m, lambda m: F.transform("ts", lambda t: F.when(t["c"] * 2 <= m, FIELD).otherwise(t["token"])))
    made = stored(each.select("template", digest(F.concat_ws(" ", "lead", F.array_join(said, " "))).alias("whole"))).where("whole != template")
    discard(mixed, places, facts)
    return made


def repeats(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, key, dropped): the places of lines to drop, from 0, in order."""
    docs = docs.select("doc_id", "text")
    line, place = F.col("line"), F.struct("doc_id", "key", "at")
    rows = stored(lines(docs).select("doc_id", "key", "at", digest(line).alias("template"), leaf(line).alias("leaf"), n_tokens(line).alias("tokens"), "line"))
    total = rows.count()
    different = stored(rows.groupBy("template").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"), F.count("*").alias("n")))
    whole = generalised(rows, different)
    names = stored(different.join(whole, "template", "left").select("template", F.coalesce("whole", "template").alias("whole"), "n"))
    # Only templates of enough rows can stand in enough documents.
    may = stored(names.groupBy("whole").agg(F.count("*").alias("lines"), F.sum("n").alias("rows")).where(F.col("rows") >= documents).select("whole", "lines"))
    named = stored(by_heat(names, may, "whole", "lines", names.count()))
    once = by_heat(rows.select("doc_id", "key", "at", "template"), named, "template", "n", total).groupBy("whole", "key").agg(F.min(place).alias("first"))
    often = once.groupBy("whole").agg(F.count("*").alias("d"), F.min("first").alias("first")).where(F.col("d") >= documents)
    often = stored(often.join(may, "whole").select("whole", "first", "lines"))
    facts = stored(by_heat(named, often, "whole", "lines", named.count()).select("template", "first", "n"))
    discard(different, whole, names, may, named, often)
    gone = by_heat(rows.select("doc_id", "key", "at", "template"), facts, "template", "n", total).where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def drop_repeats(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """docs with the recurring lines gone from `text`; adds `n_dropped` and `dropped`, their places."""
    docs = without(docs, "n_dropped", "dropped")
    d, k, at = unused(docs, "gone_from", "gone_key", "gone_at")
    gone = repeats(docs, documents).withColumnsRenamed({"doc_id": d, "key": k, "dropped": at})
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(d)) & (text_key(docs["text"]) == F.col(k)), "left")

    def rest(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(at).isNull(), docs["text"]).otherwise(let(F.split(docs["text"], "\n"), rest))
    return joined.select(
        *(text.alias(c) if c.lower() == "text" else docs[f"`{c}`"] for c in docs.columns),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(at, ","), F.lit("")).alias("dropped"),
    )


#: DuckDB's way to the rows of op10; documents have one text for an id there, so ids alone break ties.
OP10_SQL = rf"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, text, i - 1 AS pos, trim(regexp_replace(ls[i], '[ 	
]+', ' ', 'g'), ' ') AS raw FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)),
w AS (SELECT doc_id, text, pos, list_transform(string_split(raw, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS ts FROM r WHERE raw <> ''),
l AS (SELECT doc_id, text, pos, ts, array_to_string(ts, ' ') AS line FROM w),
u AS (SELECT DISTINCT line, ts, len(ts) AS n, ts[1:{LEAD}] AS lead FROM l),
p AS (SELECT line, n, lead, i, ts[i] AS token FROM (SELECT *, unnest(range({LEAD + 1}, n + 1)) AS i FROM u WHERE n > {LEAD})),
c AS (SELECT *, count(*) OVER (PARTITION BY n, lead, i, token) AS c FROM p),
m AS (SELECT line, lead, list(struct_pack(i := i, token := token, c := c) ORDER BY i) AS places, list_reverse_sort(list(c)) AS cs FROM c GROUP BY line, lead),
g AS (SELECT line, array_to_string(list_concat(lead, list_transform(places, lambda x: CASE WHEN x.c * 2 <= cs[CAST(ceil(len(cs) * {AGREE}) AS INT)] THEN '{FIELD}' ELSE x.token END)), ' ') AS whole FROM m),
f AS (SELECT doc_id, text, pos, coalesce(whole, line) AS whole FROM l LEFT JOIN g USING (line)),
o AS (SELECT whole, count(DISTINCT text) AS d, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM f GROUP BY whole HAVING count(DISTINCT text) >= {DOCUMENTS}),
x AS (SELECT doc_id, list(pos ORDER BY pos) AS gone FROM f JOIN o USING (whole) WHERE f.doc_id <> o.first.doc_id OR f.pos <> o.first.pos GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
 CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped, coalesce(array_to_string(gone, ','), '') AS dropped FROM t LEFT JOIN x USING (doc_id)
"""
