"""Benchmark decontamination by winnowing, with DataFrame functions only.

A fingerprint is the least hash of K consecutive word K-grams, K + K - 1 = 13 words: two texts that share 13
consecutive words share a fingerprint. Fingerprints of documents and items are joined; the hits are then extended:
each 13-word window of the document around a hit is cut out, looked up among the items' windows and compared word by
word. An item of fewer words is one window of its own length; all lengths are looked up in one pass over the documents.

Edge cases: a null or empty text has no words, so it is never hit and an item without words never occurs; rows
that repeat doc_id and text are one document in the joins and each get its result; rows that repeat only doc_id
are told apart by their text; null ids are compared as equal; an empty table of either kind gives no hits. Only
the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small, stored, text_key, unused

#: Words of a window, and of the K-grams that are hashed.
WINDOW, K = 13, 7
#: All ASCII characters that aren't in words, once A-Z is lower case.
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; only A-Z is made lower case. lower() is the fast way for pure ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORDS), "")


def grams(of: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order; none if there are fewer words."""
    return F.when(F.size(of) >= n, F.transform(F.sequence(F.lit(1), F.size(of) - (n - 1)), lambda i: F.xxhash64(F.slice(of, i, n)))).otherwise(F.array().cast("array<bigint>"))


def placed(of: Column, n: int) -> Column:
    """Those hashes as array<struct<n, at, h>>, with their places from 0."""
    return F.transform(grams(of, n), lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("at"), h.alias("h")))


def fingerprints(hashes: Column) -> Column:
    """The least of each K consecutive hashes, once each."""
    n = WINDOW - K + 1

    def least(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.array_min(F.slice(h, i, n)))

    return let(hashes, lambda h: F.array_distinct(F.when(F.size(h) >= n, least(h)).otherwise(F.array().cast("array<bigint>"))))


def windows(items: DataFrame) -> DataFrame:
    """(n, h, item_id, win): different windows of items that have `words`, of n words."""
    n = F.least(F.size("words"), F.lit(WINDOW))
    at = items.select("item_id", "words", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("i"))
    return at.select("n", "item_id", F.slice("words", F.col("i"), F.col("n")).alias("win")).withColumn("h", F.xxhash64("win")).distinct()


def at_documents(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, key, words, held) of the documents of places (doc_id, key, ...): their words once, beside a list of what places has of them."""
    held = F.struct(*(c for c in places.columns if c not in ("doc_id", "key")))
    rows = stored(places.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set(held).alias("held")))
    some = docs.join(small(rows), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    return some.dropDuplicates(["doc_id", "key"]).select("doc_id", "key", words(F.col("text")).alias("words"), "held")


def starts(met: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, at): the windows of WINDOW words around the grams of documents that have one of the hashes of met (doc_id, key, h).

    A document's grams are rows without its words, joined to its own hashes: time grows with the text, however much is hit.
    """
    held = at_documents(met, docs)
    gram = F.explode(placed(F.col("words"), K)).alias("g")
    each = held.select("doc_id", "key", (F.size("words") - WINDOW).alias("last"), gram).select("doc_id", "key", "last", "g.at", "g.h")
    own = small(met.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("h").alias("m")))
    hit = each.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("h") == F.col("m")))
    at = F.explode(F.sequence(F.greatest(F.col("at") - (WINDOW - K), F.lit(0)), F.least("at", "last")))
    return hit.select("doc_id", "key", F.lit(WINDOW).alias("n"), at.alias("at")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, n_hit, items): documents in which windows occur; key is text_key() of the text.

    One pass over the words of all documents gives their fingerprints and the hashes of the shorter items' lengths;
    what follows reads only documents that have a hash of the benchmark.
    """
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    items = stored(benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0))
    long = F.size("words") >= WINDOW
    of = stored(windows(items))
    prints = items.where(long).select(F.lit(WINDOW).alias("n"), F.explode(fingerprints(grams(F.col("words"), K))).alias("h"))
    marks = stored(prints.unionByName(of.where(F.col("n") < WINDOW).select("n", "h")).distinct())

    lengths = sorted(n for (n,) in marks.where(F.col("n") < WINDOW).select("n").distinct().collect())  # below 13: twelve at most
    print_ = F.transform(fingerprints(grams(F.col("words"), K)), lambda h: F.struct(F.lit(WINDOW).alias("n"), F.lit(None).cast("int").alias("at"), h.alias("h")))
    each = F.concat(print_, *(placed(F.col("words"), n) for n in lengths))
    hashed = docs.select("doc_id", "key", words(F.col("text")).alias("words")).select("doc_id", "key", F.explode(each).alias("g")).select("doc_id", "key", "g.*")
    met = stored(hashed.join(small(marks), ["n", "h"]).distinct())

    short = met.where(F.col("n") < WINDOW).select("doc_id", "key", "n", "at")
    places = starts(stored(met.where(F.col("n") == WINDOW).select("doc_id", "key", "h")), docs).unionByName(short)
    # each place with its own n words, no more
    cut = at_documents(places, docs).select("doc_id", "key", F.explode(F.transform("held", lambda p: F.struct(p["n"].alias("n"), p["at"].alias("at"), F.slice("words", p["at"] + 1, p["n"]).alias("own")))).alias("w"))
    cut = cut.select("doc_id", "key", "w.*").withColumn("h", F.xxhash64("own"))
    found = cut.join(small(of), ["n", "h"]).where(F.col("own") == F.col("win"))

    # at most one row per document, place and length, then their union
    spans = found.select("doc_id", "key", F.struct("at", (F.col("at") + F.col("n")).alias("end")).alias("span"), "item_id")
    grouped = spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(s["to"], x["at"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")), lambda s: s["n"])
    return grouped.select("doc_id", "key", covered.cast("long").alias("n_hit"), F.sort_array("items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, items, contaminated (a twentieth of the words hit)."""
    found = hits(docs, benchmark).withColumnsRenamed({"doc_id": "d", "key": "k"})
    all_ = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = all_.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    d, k, n = unused(docs, "hit_id", "hit_key", "hit_words")
    found = hits(docs, benchmark).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("n_hit").alias(n))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(d)) & (text_key(docs["text"]) == F.col(k)), "left")
    bad = F.coalesce((F.col(n) > 0) & (20 * F.col(n) >= F.size(words(docs["text"]))), F.lit(False))
    return joined.where(~bad).select([docs[f"`{c}`"] for c in docs.columns])


#: DuckDB's way to the rows of op9.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
