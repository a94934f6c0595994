"""Source divergence audit: how far each source's terms stray from those of each other source, and of its language.

Rows of identical texts of a language are collapsed first: their digests are counted by source, and one text of
each digest is tokenized, once; its document frequencies and counts weigh by the multiplicities. Pairs of sources are
then evaluated sparsely: a pair's sum is that of terms that neither has, plus what each source's own terms change (by
its histogram of counts, as all terms of one count change alike), plus what terms that both have change.
All numbers are whole, so every sum is exact.

Edge cases: a null text, lang or source reads as ''; rows that repeat count as often; a group without terms, a
language without kept terms (pairs of 0) and a language of one source (no pairs) are kept; an empty table gives no
rows. Only text, lang and source are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_heat, is_small, small, stored

#: Documents that a kept term is in, at least; scale of shares; ranks of a group's terms.
DOCUMENTS, SCALE, TERMS = 3, 1_000_000_000, 200
#: Terms that a task counts before it passes them on, looked at each so many words; pairs that a task evaluates at once; salts of a join on languages alone.
COUNTED, LOOK, PAIRS, SALTS = 300_000, 50_000, 2_000_000, 64
#: Bytes of UTF-8: A-Z become small, all of ASCII but letters becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def collapsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, text, sources: array of (source, n)), a row for each different text of a language; and (lang, source) that occur.

    Texts are shuffled once, each at most once by a task; what is counted of them is their digests.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    keyed = read.withColumn("digest", F.unhex(F.sha2("text", 256)))
    times = stored(keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")))
    by_text = times.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))  # a text has as many rows as sources
    texts = keyed.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    return texts.join(by_text, ["lang", "digest"]).select("lang", "text", "sources"), times.select("lang", "source").distinct()


def tokenized(texts: DataFrame) -> DataFrame:
    """(lang, term, entries: array of (source, n)) counts of terms, and under a null source the documents that have them; a row for each task that has a term."""
    kind = "lang string, term string, entries array<struct<source:string,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str | None], Counter] = defaultdict(Counter)
        new = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang in {lang for lang, _ in seen}:
                place: dict[bytes, int] = {}
                own = [(source, terms) for (g, source), terms in seen.items() if g == lang]
                at = np.concatenate([np.fromiter((place.setdefault(t, len(place)) for t in terms), np.int64, len(terms)) for _, terms in own])
                order = np.argsort(at, kind="stable")
                n = np.concatenate([np.fromiter(terms.values(), np.int64, len(terms)) for _, terms in own])[order]
                source = np.repeat(np.arange(len(own)), [len(terms) for _, terms in own])[order]
                names = pa.array([s for s, _ in own], pa.string()).take(pa.array(source))
                bounds = np.append(0, np.cumsum(np.bincount(at, minlength=len(place)))).astype(np.int32)
                entries = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([names, pa.array(n)], names=["source", "n"]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(place), pa.string()), pa.array(list(place), pa.binary()).cast(pa.string()), entries], names=["lang", "term", "entries"])

        for b in batches:
            for lang, text, sources in zip(b.column("lang").to_pylist(), b.column("text"), b.column("sources").to_pylist(), strict=True):
                words = text.as_py().encode().translate(LETTERS).split()
                total = sum(s["n"] for s in sources)
                if total == 1:
                    seen[lang, sources[0]["source"]].update(words)
                    seen[lang, None].update(set(words))
                else:
                    for w, k in Counter(words).items():
                        seen[lang, None][w] += total
                        for s in sources:
                            seen[lang, s["source"]][w] += k * s["n"]
                new += len(words) * len(sources)
                if new > LOOK:
                    new = 0
                    if sum(map(len, seen.values())) > COUNTED:
                        yield from out()
                        seen.clear()
        yield from out()

    return texts.mapInArrow(run, kind)


def share(n: Column | int, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / whole), in decimals where a long is too short; null without a whole."""
    n, whole = (F.lit(n) if isinstance(n, int) else n).cast("long"), F.nullif(whole, F.lit(0))
    few = F.call_function("div", (n + 1) * SCALE, whole)
    many = F.call_function("div", (n.cast("decimal(19,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))
    return F.when(n < 9_000_000_000, few).otherwise(many) + 1


def strays(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, s, t, value) sums over terms that both sources of a pair have, from rows (lang, sid, p, zero) of arrays by term.

    Each is what the term gives, less what it gave if either or both of them hadn't it: `zero` is p of such a term.
    """

    def evaluated(lang: np.ndarray, names: pa.Array, size: np.ndarray, sid: np.ndarray, p: np.ndarray, zero: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(size)), size)
        begin, many = (np.cumsum(size) - size)[row], size[row]
        m = int(sid.max(initial=0)) + 1
        at, past = 0, np.cumsum(many)
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + PAIRS, "right")))
            s = np.repeat(np.arange(at, to), many[at:to])
            t = np.arange(len(s)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to]) + begin[s]
            s, t = s[s != t], t[s != t]
            at = to
            f = lambda a, b: (a - b) ** 2 // b
            value = f(p[s], p[t]) - f(p[s], zero[t]) - f(zero[s], p[t]) + f(zero[s], zero[t])
            keys, place = np.unique((lang[row[s]] * m + sid[s]) * m + sid[t], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, value)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(keys // (m * m))), pa.array(keys // m % m), pa.array(keys % m), pa.array(sums)], names=["lang", "s", "t", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lang = b.column("lang").dictionary_encode()
                size = np.diff(b.column("sid").offsets.to_numpy().astype(np.int64))
                flat = [b.column(c).flatten().to_numpy().astype(np.int64) for c in ("sid", "p", "zero")]
                yield from evaluated(np.asarray(lang.indices).astype(np.int64), lang.dictionary, size, *flat)

    return rows.mapInArrow(run, "lang string, s long, t long, value long")


def with_others(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (lang, s, ...) beside each group of their language as t, zero_t: a result has as many pairs. groups must be stored."""
    other = groups.select("lang", F.col("sid").alias("t"), F.col("zero").alias("zero_t"))
    if is_small(other):
        made = rows.join(F.broadcast(other), "lang")
    else:
        salted = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        made = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    return made.where("s <> t")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source): pairs of sources, and each group's terms over its language's share."""
    texts, occurring = collapsed(docs)
    # dealt out by term, once: a term has a row for each task at most; all that follows by term needs no other shuffle
    counted = tokenized(texts).repartition("lang", "term").select("lang", "term", F.explode("entries").alias("e")).groupBy("lang", "term", "e.source").agg(F.sum("e.n").alias("n"))
    entry = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    terms = counted.groupBy("lang", "term").agg(F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("documents"), F.collect_list(entry).alias("entries"))
    terms = stored(terms.where(F.col("documents") >= DOCUMENTS).select("lang", "term", F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["n"]).alias("total"), "entries"))
    each = terms.select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", F.struct("lang", "e.source").alias("g"), F.col("e.n").alias("n"))
    # of each group: its number in the language, its terms and their occurrences, those of the language, p of terms that it hasn't
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = each.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    groups = occurring.withColumn("g", F.struct("lang", "source")).join(sums, "g", "left").join(langs, "lang", "left")
    zeros = groups.select("g", "lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "rows", "v", "lang_n")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")  # as many rows as a language has sources
    groups = stored(zeros.select("g", "lang", "source", number.alias("sid"), "rows", "v", (F.col("n") + F.col("v")).alias("whole"), (F.col("lang_n") + F.col("v")).alias("lang_whole")).withColumn("zero", share(0, F.col("whole"))))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    facts = groups.select("g", "rows", "sid", "whole", "lang_whole", "zero")
    own = by_heat(each, facts, "g", "rows", total).withColumn("p", share(F.col("n"), F.col("whole")))

    top = own.select("g.lang", "g.source", F.lit("term").alias("part"), F.col("term").alias("item"), "p", share(F.col("total"), F.col("lang_whole")).alias("q")).where("p > q")
    top = top.select("lang", "source", "part", "item", strays(F.col("p"), F.col("q")).alias("value"))

    value = strays(F.col("zero"), F.col("zero_t"))
    neither = with_others(groups.select("lang", F.col("sid").alias("s"), "v", "zero"), groups).select("lang", "s", "t", F.coalesce(F.col("v") * value, F.lit(0)).alias("value"))
    alike = own.groupBy("g.lang", F.col("sid").alias("s"), "p", "zero").agg(F.count("*").alias("h"))
    beside = with_others(alike, groups)
    change = F.col("h") * (strays(F.col("p"), F.col("zero_t")) - value)
    back = F.col("h") * (strays(F.col("zero_t"), F.col("p")) - strays(F.col("zero_t"), F.col("zero")))
    alone = beside.select("lang", F.explode(F.array(F.struct("s", "t", change.alias("value")), F.struct(F.col("t").alias("s"), F.col("s").alias("t"), back.alias("value")))).alias("e")).select("lang", "e.*")
    by_term = own.groupBy("g.lang", "term").agg(F.collect_list(F.struct("sid", "p", "zero")).alias("e")).where(F.size("e") > 1)  # as many entries as sources
    both = shared_terms(by_term.select("lang", "e.sid", "e.p", "e.zero"))
    pairs = neither.unionByName(alone).unionByName(both).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    named = small(groups.select("lang", F.col("sid").alias("s"), "source"))
    pairs = pairs.join(named, ["lang", "s"]).join(named.withColumnsRenamed({"s": "t", "source": "item"}), ["lang", "t"])
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = [x.withColumn("rank", rank) for x in (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"), top)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= TERMS))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
gs AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS gn FROM c GROUP BY lang, source),
lq AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (any_value(ln) + any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS ln FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
p AS (SELECT gs.lang, gs.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(gn, 0) + v) AS p
  FROM gs JOIN kept k ON k.lang = gs.lang JOIN v ON v.lang = gs.lang LEFT JOIN gn ON gn.lang = gs.lang AND gn.source = gs.source
  LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN lq USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm) QUALIFY part = 'pair' OR rank <= 200
"""
