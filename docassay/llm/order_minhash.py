"""Near-duplicate classes by Order MinHash.

Texts with the same words are one text. Of each text, SKETCHES times, the RETAINED least hashes of its word
5-grams, labelled with their occurrence, are taken and kept in text order; their hash is a bucket. Texts of a bucket
are verified by banded alignment of their 5-gram sequences: with m of a and b aligned in order, the similarity is
m / (a + b - m), and the band is as wide as a similarity of 0.8 allows; pairs whose lengths, or counts of grams by
256 remainders, rule that out are left.

First the least text of a bucket is tried with each other one, then one text of each class with its neighbours by
length: these two passes link most of what is similar at a cost that grows with the rows. Whatever still stands apart
in a bucket is finished exactly: all its pairs of texts of different classes are verified or ruled out, in small
buckets one by one, in large ones between blocks of texts. So each two similar texts that share a bucket are in one
class, however large the bucket. Linked texts form classes.

Edge cases: a null text is an empty one; texts of fewer than five words are one gram; texts without words form one
class; rows that repeat only doc_id are told apart by text; null ids are ids, one_of_each takes them last; an empty
table gives an empty one. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_heat, discard, mapped, small, stored, text_key, unused

#: Words of a gram, least similarity; sketches of a text, minima retained in each.
GRAM, SIMILAR = 5, 0.8
SKETCHES, RETAINED = 20, 3
#: Neighbours by length with which one text of a class is tried in the second pass; the third pass tries all others.
NEIGHBOURS = 4
#: Texts of a bucket up to which pairs are made one by one; texts, and grams, of a block in larger ones.
PAIRED, BLOCK, BLOCK_GRAMS = 64, 512, 1 << 20
BINS = 256
#: Words whose hashes a Python worker keeps.
KNOWN = 1 << 17
WORD = re.compile(r"\w+")
_MIX = np.random.default_rng(7).integers(1, 2**63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)


def word_hashes(found: list[str], known: dict[str, int]) -> np.ndarray:
    """32-bit hashes of words; only runs of five are ever compared."""
    try:
        return np.array([known[w] for w in found], "<u4")
    except KeyError:
        if len(known) > KNOWN:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little")
        return np.array([known[w] for w in found], "<u4")


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of five words; of a shorter text, of all its words."""
    w = words.astype(np.uint64)
    n = max(1, len(w) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(GRAM, len(w))):
        h = (h ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes with the number of earlier equal ones mixed in."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return h
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return h ^ (nth * np.uint64(0xD6E8FEB86659FD93))


def sketches(words: np.ndarray) -> np.ndarray:
    """Buckets of a text, without words or with them, one for each sketch."""
    h = labelled(gram_hashes(words)) if len(words) else np.zeros(1, np.uint64)
    buckets = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 20) // len(h))  # sketches worked out at once
    for t in range(0, SKETCHES, step):
        mix = _MIX[t : t + step]
        x = (h ^ mix[:, :1]) * mix[:, 1:]
        x ^= x >> np.uint64(32)
        x *= mix[:, :1]
        if len(h) > RETAINED:
            at = np.sort(np.argpartition(x, RETAINED, axis=1)[:, :RETAINED], axis=1)
            x = np.take_along_axis(x, at, axis=1)
        b = np.arange(t + 1, t + 1 + len(mix), dtype=np.uint64)
        for v in x.T:
            b = (b * np.uint64(0x100000001B3)) ^ v
            b ^= b >> np.uint64(31)
        buckets[t : t + step] = b
    return buckets.view(np.int64)


def binned(h: np.ndarray) -> np.ndarray:
    """Counts of grams by remainder; the sum of the lesser counts of two texts bounds the grams that they share."""
    return np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.int32)


def unaligned(total):
    """Grams of two texts with `total` ones that can stay unaligned at SIMILAR, at most."""
    return np.floor(total * (1 - 2 * SIMILAR / (1 + SIMILAR)) + 1e-9)


def aligned(a: np.ndarray, b: np.ndarray, widest: int) -> int:
    """Grams of both sequences that can be aligned in order, if at most `widest` stay unaligned; else some lesser number.

    Places of equal grams, within the band, are the points of which a longest rising chain is taken: most grams occur
    once, so points are few. Texts that repeat their grams are aligned along furthest-reaching diagonals instead.
    """
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    count = high - low
    points = int(count.sum())
    if points > 4 * (len(a) + len(b)):
        return _by_diagonals(a, b, widest)
    i = np.repeat(np.arange(len(a)), count)
    back = np.arange(points) - np.repeat(np.cumsum(count) - count, count)
    j = order[np.repeat(high, count) - 1 - back]  # of one place in a, those in b backwards, so that one is taken
    chain: list[int] = []
    for at in j[np.abs(i - j) <= widest].tolist():
        k = bisect_left(chain, at)
        if k == len(chain):
            chain.append(at)
        else:
            chain[k] = at
    return len(chain)


def _by_diagonals(a: np.ndarray, b: np.ndarray, widest: int) -> int:
    n, m = len(a), len(b)
    reach = np.full(2 * widest + 3, -1)
    mid = widest + 1
    reach[mid + 1] = 0
    for d in range(min(widest, n + m) + 1):
        k = np.arange(-d, d + 1, 2)
        down, right = reach[mid + k + 1], reach[mid + k - 1] + 1
        x = np.where((k == -d) | ((k != d) & (right <= down)), down, right)
        y = x - k
        live = np.flatnonzero((x < n) & (y < m) & (y >= 0))
        while len(live):
            live = live[a[x[live]] == b[y[live]]]
            x[live] += 1
            y[live] += 1
            live = live[(x[live] < n) & (y[live] < m)]
        reach[mid + k] = x
        if ((x >= n) & (y >= m)).any():
            return (n + m - d) // 2
    return 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two gram sequences, m / (a + b - m) with m grams aligned in order; 0 if that is below SIMILAR.

    At SIMILAR, at most (a + b) / 9 grams stay unaligned, which bounds the band.
    """
    total = len(a) + len(b)
    widest = int(unaligned(total))
    both = np.intersect1d(*(labelled(x) for x in (a, b)), assume_unique=True).size
    if total - 2 * both > widest:
        return 0.0
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    tail = int(differ[0]) if len(differ) else same
    m = head + tail + aligned(a[: len(a) - tail], b[: len(b) - tail], widest)
    return m / (total - m) if total - 2 * m <= widest else 0.0


def _sketched(batch: pa.RecordBatch, known: dict[str, int]) -> pa.RecordBatch:
    """Of each text the digest of its words, by which copies are known, their hashes, how many grams they have, and their buckets."""
    made: dict[bytes, tuple[bytes, int, np.ndarray]] = {}
    keys = []
    for t in batch.column("text"):
        found = WORD.findall((t.as_py() or "").lower())
        keys.append(hashlib.md5("\0".join(found).encode("utf-8", "surrogatepass")).digest())
        if keys[-1] not in made:
            words = word_hashes(found, known)
            made[keys[-1]] = words.tobytes(), max(1, len(words) - GRAM + 1), sketches(words)
    columns = [pa.array([made[k][c] for k in keys], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), *columns], names=["doc_id", "text_key", "key", "words", "grams", "buckets"])


def of_keys(texts: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """(key, columns) of the texts with these keys, once each: copies meet here, so that no other text is ever shuffled."""
    some = texts.select("key", *columns).join(small(stored(keys.distinct())), "key", "leftsemi")
    return some.groupBy("key").agg(*(F.first(c).alias(c) for c in columns))


def candidates(rows: DataFrame, total: int) -> DataFrame:
    """(a, b), a < b: pairs of the least text of each bucket of rows (bucket, grams, key) with its others."""
    least = rows.groupBy("bucket").agg(F.min(F.struct("key", "grams")).alias("least"), F.max("key").alias("last"), F.count("*").alias("c")).where("least.key < last")
    least = stored(least.select("bucket", F.col("least.key").alias("a"), F.col("least.grams").alias("n"), "c"))
    pairs = by_heat(rows, least, "bucket", "c", total).where("a < key")
    near = F.least("n", "grams") >= SIMILAR * F.greatest("n", "grams")
    return pairs.where(near).select("a", F.col("key").alias("b")).distinct()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of keys at most NEIGHBOURS rows apart in one bucket, of like length; rows are sorted by bucket and length."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        old = rest.num_rows if rest is not None else 0
        t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        bucket, grams, key = t.column("bucket").to_numpy(), t.column("grams").to_numpy(), t.column("key")
        for d in range(1, NEIGHBOURS + 1):
            at = np.flatnonzero(bucket[d:] == bucket[:-d]) + d if len(bucket) > d else np.empty(0, int)
            at = at[(at >= old) & (grams[at - d] >= SIMILAR * grams[at])]
            x, y = key.take(pa.array(at - d)), key.take(pa.array(at))
            yield from pa.table({"a": pc.min_element_wise(x, y), "b": pc.max_element_wise(x, y)}).to_batches()
        rest = t.slice(max(0, t.num_rows - NEIGHBOURS))


def between(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of texts with different leaders (key, root) that share a bucket of rows, all shared."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = rows.join(roots, "key", "left").select("bucket", F.coalesce("root", "key").alias("root"), "key", "grams")
    one = root.groupBy("bucket", "root").agg(F.min_by(F.struct("key", "grams"), F.xxhash64("key", "bucket")).alias("one"))
    dealt = one.select("bucket", "one.grams", "one.key").repartitionByRange(n, "bucket", "grams", "key").sortWithinPartitions("bucket", "grams", "key")
    return dealt.mapInArrow(_neighbours, "a binary, b binary").where("a < b").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (key, words), in any number of copies, are similar, with `similarity`."""

    def side(x: str) -> DataFrame:
        return of_keys(texts, pairs.select(F.col(x).alias("key")), "words").select(F.col("key").alias(x), F.col("words").alias(f"words_{x}"))

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def grams(w: bytes) -> tuple[np.ndarray, np.ndarray]:
            if w not in known:
                if len(known) > 500:
                    known.clear()
                g = gram_hashes(np.frombuffer(w, "<u4"))
                known[w] = g, binned(g)
            return known[w]

        def score_of(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
            total = len(a) + len(b)
            return similarity(a, b) if total - 2 * int(np.minimum(x, y).sum()) <= unaligned(total) else 0.0

        score = [score_of(*grams(x.as_py()), *grams(y.as_py())) for x, y in zip(batch.column("words_a"), batch.column("words_b"), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], names=["a", "b", "similarity"])
        return out.filter(pc.greater_equal(out.column("similarity"), SIMILAR))

    return mapped(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "words_b"), "a binary, b binary, similarity double", check)


def _across(table: pa.Table) -> pa.Table:
    """Links (a, b, similarity) between the texts of two blocks of a bucket, or within one, that join different roots.

    A pair that shares an earlier bucket too is left to that one.
    """
    packed = [gram_hashes(np.frombuffer(w.as_py(), "<u4")) for w in table.column("words")]
    size = np.array([len(g) for g in packed])
    bins = np.array([binned(g) for g in packed])
    buckets = np.array(table.column("buckets").to_pylist(), np.int64)
    nth = int(np.flatnonzero(buckets[0] == table.column("bucket")[0].as_py())[0])
    keys, side = table.column("key").to_pylist(), table.column("side").to_numpy()
    names: dict[bytes, int] = {}
    root = np.array([names.setdefault(r, len(names)) for r in table.column("root").to_pylist()])
    within = table.column("i")[0].as_py() == table.column("j")[0].as_py() and not table.column("big")[0].as_py()
    left, right = np.flatnonzero(side == 0), np.arange(len(size)) if within else np.flatnonzero(side == 1)
    may = []
    for i in left:
        at = right[right > i] if within else right
        total = size[i] + size[at]
        widest = unaligned(total)
        at, total, widest = (x[(root[at] != root[i]) & (np.abs(size[at] - size[i]) <= widest)] for x in (at, total, widest))
        if not len(at):
            continue
        new = ~(buckets[at, :nth] == buckets[i, :nth]).any(axis=1)
        at, total, widest = at[new], total[new], widest[new]
        apart = total - 2 * np.minimum(bins[at], bins[i]).sum(axis=1)
        may += [(apart[k] / total[k], int(i), int(at[k])) for k in np.flatnonzero(apart <= widest)]
    leader = list(range(len(names)))

    def find(x: int) -> int:
        while leader[x] != x:
            leader[x] = x = leader[leader[x]]
        return x

    links = []
    for _, i, j in sorted(may):
        x, y = find(root[i]), find(root[j])
        if x != y and (score := similarity(packed[i], packed[j])) >= SIMILAR:
            leader[y] = x
            links.append((*sorted((keys[i], keys[j])), score))
    return pa.table([pa.array([k[c] for k in links], t) for c, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], names=["a", "b", "similarity"])


def finished(rows: DataFrame, texts: DataFrame, roots: DataFrame, tried: DataFrame) -> DataFrame:
    """Links (a, b, similarity) between classes (key, root) that share buckets (bucket, grams, key): no two similar texts of a bucket stay apart."""
    named = stored(rows.join(small(roots), "key", "left").withColumn("root", F.coalesce("root", "key")))
    by_root = named.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("grams").alias("g"))
    facts = by_root.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("g").alias("g"), F.max(F.struct("n", "g", "root")).alias("most")).where("k > 1")
    facts = stored(facts.drop("k"))
    few = stored(named.join(facts.where(F.col("n") <= PAIRED).select("bucket"), "bucket", "leftsemi"))
    others = few.withColumnsRenamed({"key": "b", "root": "other", "grams": "m"})
    near = F.least("m", "grams") >= SIMILAR * F.greatest("m", "grams")
    pairs = few.join(others, "bucket").where((F.col("key") < F.col("b")) & (F.col("root") != F.col("other")) & near).select(F.col("key").alias("a"), "b").distinct()
    pairs = stored(pairs.join(tried, ["a", "b"], "leftanti"))
    links = stored(verified(pairs, texts))
    discard(few, pairs)

    # Larger buckets: the texts of the most common root form blocks, which meet the blocks of the others, and those each other.
    blocks = lambda n, g: F.ceil(F.greatest(n / BLOCK, g / BLOCK_GRAMS)).cast("int")
    large = facts.where(F.col("n") > PAIRED).select("bucket", F.col("most.root").alias("top"), blocks(F.col("most.n"), F.col("most.g")).alias("n_big"), blocks(F.col("n") - F.col("most.n"), F.col("g") - F.col("most.g")).alias("n_rest"))
    sized = facts.where(F.col("n") > PAIRED).select("bucket", F.col("n").alias("rows"))
    held = by_heat(named, stored(large.join(sized, "bucket")), "bucket", "rows", named.count()).withColumn("big", F.col("root") == F.col("top"))
    held = stored(held.withColumn("at", F.pmod(F.xxhash64("key"), F.when(F.col("big"), F.col("n_big")).otherwise(F.col("n_rest"))).cast("int")))
    to = lambda big, i, j, side: F.struct(F.lit(big).alias("big"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    at = F.col("at")
    from_big = F.transform(upto("n_rest"), lambda i: to(True, i, at, F.lit(1)))
    from_rest = F.concat(F.transform(upto("n_rest"), lambda j: to(False, F.least(at, j), F.greatest(at, j), at > j)), F.transform(upto("n_big"), lambda j: to(True, at, j, F.lit(0))))
    words = of_keys(texts, held.select("key"), "words", "buckets")
    dealt = held.join(words, "key").select("bucket", "key", "root", "words", "buckets", F.explode(F.when(F.col("big"), from_big).otherwise(from_rest)).alias("to"))
    met = dealt.select("bucket", "to.*", "key", "root", "words", "buckets").groupBy("bucket", "big", "i", "j").applyInArrow(_across, "a binary, b binary, similarity double")
    met = stored(met.join(tried, ["a", "b"], "leftanti"))
    discard(named, facts, held)
    return links.unionByName(met)


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m): pairs (u, v), stored, with the least of u and all its v, and that table; a hub's pairs don't meet in one task."""
    facts = stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
    return by_heat(pairs, facts, "u", "n", pairs.count()), facts


def components(links: DataFrame) -> DataFrame:
    """(key, root): for each key in links (a, b), the least key that it is connected to, by large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        joined, least = _with_least(both)
        large = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        discard(both, least, edges)
        joined, least = _with_least(large)
        small_ = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = stored(small_.where("u <> v").distinct())
        discard(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))


def members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each document (doc_id, text_key, key of its words); of each key (key, first, n, root, n_links)."""
    known: dict[str, int] = {}
    read = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, key binary, words binary, grams long, buckets array<long>"
    texts = stored(mapped(read, schema, lambda b: _sketched(b, known)))  # words are shuffled only of texts that are to be verified
    all_ = stored(texts.select("doc_id", "text_key", "key"))
    once = stored(texts.groupBy("key").agg(F.first("grams").alias("grams"), F.first("buckets").alias("buckets")))
    rows = once.select(F.explode("buckets").alias("bucket"), "grams", "key")
    several = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    rows = stored(rows.join(several, "bucket", "leftsemi"))
    discard(once)
    tried = stored(candidates(rows, rows.count()))
    links = stored(verified(tried, texts))
    leaders = links.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("root"))
    second = stored(between(rows, leaders).join(tried, ["a", "b"], "leftanti"))
    links = stored(links.unionByName(verified(second, texts)))
    more = finished(rows, texts, stored(components(links)), stored(tried.unionByName(second)))
    links = stored(links.unionByName(more.dropDuplicates(["a", "b"])))
    discard(texts, rows, tried, second)
    roots = components(links)
    degree = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
    copies = all_.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    member = copies.join(roots, "key", "left").join(degree, "key", "left").select("key", "first", "n", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return all_, stored(member)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_links of its text, and class_size."""
    all_, member = members(docs)
    whole = stored(member.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("texts")))
    named = stored(by_heat(member, whole, "root", "texts", member.count()).select("key", "n", "class_id", "class_size", "n_links"))
    return by_heat(all_, named, "key", "n", all_.count()).select("doc_id", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, all its columns: that of the least doc_id (null last), of several under it, of the least text key."""
    all_, member = members(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = all_.groupBy("key").agg(F.min(place).alias("p"))  # copies meet before the classes do
    stay = first.join(member.select("key", "root"), "key").groupBy("root").agg(F.min("p").alias("p"))
    at = unused(docs, "own_id", "own_none", "own_key")
    named = lambda i, k: [c.alias(n) for c, n in zip((F.coalesce(i.cast("string"), F.lit("")), i.isNull(), k), at, strict=True)]
    own = docs.select("*", *named(docs["doc_id"], text_key(docs["text"])))
    stay = stored(stay.select(*named(F.col("p.doc_id"), F.col("p.text_key"))))
    return own.join(small(stay), at, "leftsemi").dropDuplicates(at).drop(*at)  # by the same columns, so texts are shuffled once
