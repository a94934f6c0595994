"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists of the vocabulary.

A pair that is one edit apart shares its first or its last half, taken by the longer word's length. So each word
stands in the lists of its halves, forward and backward, for its own length and, as a query only, for that of words
one longer. A list is sorted; its ranges of common prefixes are walked level by level, each with a row of the edit
matrix (a band of three cells) that all words of the range use, as the longest common prefixes of neighbours tell
where ranges part. A range is skipped once its prefix is over one edit away. All queries of some lists are walked
together, in numpy. A list of more than LIST words is dealt out in blocks, and its words query each block.

Edge cases: a null text has no words; a null doc_id reads as an empty one in the hash; rows that repeat count as
often; an empty table gives no rows. Runs of any length are whole words. Only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small, stored

#: One run in VARIED loses a code point; words have LEAST code points and TWICE occurrences; a form has TIMES the word's.
VARIED, LEAST, TWICE, TIMES = 31, 7, 2, 10
#: Words of a list's block; rows that are walked at once; words that a task counts before it passes them on.
LIST, ROWS, COUNTED = 20_000, 40_000, 300_000
#: Bytes of ISO 8859-1: A-Z become small, what isn't in `[A-Za-zÀ-ÿ]` becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Runs of letters of a text that have LEAST code points, in ISO 8859-1, where one is a byte; other code points part runs."""
    return [w for w in text.encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= LEAST]


def varied(counts: Counter, doc_id: object) -> Iterator[tuple[bytes, int]]:
    """The words that a document's runs give: where VARIED divides the hash, one code point is gone."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in counts.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), prefix)
        if h % VARIED == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
            if len(w) < LEAST:
                continue
        yield w, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur TWICE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in seen], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                for w, n in varied(Counter(runs(t.as_py() or "")), i):
                    seen[w] = seen.get(w, 0) + n
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def lists(words: DataFrame) -> DataFrame:
    """(list, block, role, back, t, word, n): each word in its lists; role 0 is listed and queries, 1 queries only.

    words must be stored: it is read twice.
    """
    size = F.char_length("word")
    each = F.explode(F.array(*(F.struct(F.lit(back).alias("back"), (size + more).alias("t"), F.lit(more).alias("role")) for back in (False, True) for more in (0, 1))))
    rows = words.select("word", "n", each.alias("e")).select("n", "e.*", F.when(F.col("e.back"), F.reverse("word")).otherwise(F.col("word")).alias("word"))
    half = F.floor(F.col("t") / 2).cast("int")
    key = F.concat(F.when(F.col("back"), "b").otherwise("f"), F.col("t").cast("string"), F.lit(":"), F.substring("word", F.lit(1), F.when(F.col("back"), F.col("t") - half).otherwise(half)))
    rows = rows.withColumn("list", key)
    long = rows.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > LIST)  # one row for LIST words at most
    long = stored(long.select("list", F.ceil(F.col("size") / LIST).cast("int").alias("blocks")))
    rows = rows.join(small(long), "list", "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    rows = rows.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    role = F.when((F.col("role") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1)
    return rows.select("list", "block", role.alias("role"), "back", "t", F.encode("word", "ISO-8859-1").alias("word"), "n")


def binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins; one entry more marks the end."""
    a = column.cast(pa.binary()).combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(a.buffers()[2] or b"\0", np.uint8), at


def walk(flat: np.ndarray, at: np.ndarray, lists_: np.ndarray, listed: np.ndarray, asks: np.ndarray, share: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, listed) that are one edit apart and share `share` first bytes; words come list by list, the listed ones sorted.

    lists_ numbers each row's list; t is the length of a list's words.
    """
    size = at[1:] - at[:-1]
    index = np.flatnonzero(listed)
    first = np.searchsorted(lists_[index], lists_)
    asking = np.flatnonzero(asks & (first < len(index)))
    asking = asking[lists_[index[first[asking]]] == lists_[asking]]
    none = np.empty(0, np.int64)
    if not len(asking):
        return none, none
    # bytes that a listed word shares with the one before it, less those that all of its list do; -1 begins a list
    common = np.full(len(index), -1)
    on = np.flatnonzero(lists_[index[1:]] == lists_[index[:-1]]) + 1
    depth = share[index].copy()
    while len(on):
        common[on] += 1
        d = depth[on] + common[on]
        on = on[(d < t[index[on]]) & (flat[np.minimum(at[index[on]] + d, len(flat) - 1)] == flat[np.minimum(at[index[on - 1]] + d, len(flat) - 1)])]
    place = np.full(len(at) - 1, -1)
    place[index] = np.arange(len(index))
    found_q, found_w = [none], [none]
    starts = np.flatnonzero(common < 0)
    q, node = asking, np.searchsorted(starts, first[asking])
    before, here, after = np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
    after[share[q] + 1 > size[q]] = 2
    step = 0
    while len(q):
        deeper = np.flatnonzero(common <= step)
        child = np.searchsorted(deeper, starts)
        many = np.diff(np.append(child, len(deeper)))
        letters = flat[np.minimum(at[index[deeper]] + share[index[deeper]] + step, len(flat) - 1)]
        n = many[node]
        up = np.repeat(np.arange(len(q)), n)
        node = np.repeat(child[node] - (np.cumsum(n) - n), n) + np.arange(len(up))
        q, c = q[up], letters[node]
        d = share[q] + step
        end = size[q]
        wrong = [((d + k < 0) | (d + k >= end) | (flat[np.clip(at[q] + d + k, 0, len(flat) - 1)] != c)).astype(np.int8) for k in (-1, 0, 1)]
        before, here, after = before[up], here[up], after[up]
        less = np.minimum(before + wrong[0], here + 1)
        same = np.minimum(np.minimum(here + wrong[1], after + 1), less + 1)
        more = np.minimum(after + wrong[2], same + 1)
        more[d + 2 > end] = 2
        same[d + 1 > end] = 2
        live = np.minimum(np.minimum(less, same), more) <= 1
        starts, step = deeper, step + 1
        done = live & (share[q] + step == t[q])
        hit = done & (np.where(size[q] == t[q], same, less) == 1)
        found_q.append(q[hit])
        found_w.append(index[starts[node[hit]]])
        alone = (np.append(starts[1:], len(index)) - starts == 1)[node] & (place[q] == starts[node])  # only the query itself
        live &= ~done & ~alone
        q, node, before, here, after = q[live], node[live], less[live], same[live], more[live]
    return np.concatenate(found_q), np.concatenate(found_w)


SIDE = "word string, n_near long, form_n long, form string"


def near(rows: pa.Table, past: int) -> pa.RecordBatch:
    """Of each word of rows (sorted lists) that has near ones: how many, and the one of largest n. The first `past` rows have asked before."""
    flat, at = binary(rows["word"])
    key = rows["list"].combine_chunks().dictionary_encode()
    key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
    ids = np.asarray(key.indices)
    block, role, back, t, n = (rows[c].to_numpy() for c in ("block", "role", "back", "t", "n"))
    number = np.cumsum(np.append(0, (np.diff(ids) != 0) | (np.diff(block) != 0)))
    half = t // 2
    asks = np.arange(len(t)) >= past
    q, w = walk(flat, at, number, role == 0, asks, np.where(back, t - half, half).astype(np.int64), t.astype(np.int64))
    words = [bytes(x) for x in rows["word"].to_pylist()]

    def first_differs(a: bytes, b: bytes, at_least: int) -> bool:
        return a[::-1][:at_least] != b[::-1][:at_least]

    # a pair that shares both halves is taken forward only
    kept = np.fromiter((not back[i] or first_differs(words[i], words[j], int(half[j])) for i, j in zip(q, w, strict=True)), bool, len(q))
    q, w = q[kept], w[kept]
    longer = at[q + 1] - at[q] < at[w + 1] - at[w]  # the listed word learns of it here; of equal length, it asks itself
    one, other = np.concatenate([q, w[longer]]), np.concatenate([w, q[longer]])
    best: dict[bytes, tuple[int, int, bytes]] = {}
    for i, j in zip(one.tolist(), other.tolist(), strict=True):
        a, b = (words[i][::-1], words[j][::-1]) if back[i] else (words[i], words[j])
        m, k, v = best.get(a, (0, -1, b""))
        c = int(n[j])
        best[a] = (m + 1, c, b) if c > k or c == k and b < v else (m + 1, k, v)
    made = [(a.decode("latin-1"), m, k, v.decode("latin-1")) for a, (m, k, v) in best.items()]
    columns = zip(*made, strict=True) if made else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "form_n", "form"])


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """near() over sorted rows, ROWS at a time, by whole lists; of a list that is longer, the listed words stay for the queries that follow."""
    held, past = None, 0
    for b in batches:
        b = pa.Table.from_batches([b])
        held = b if held is None else pa.concat_tables([held, b])
        if len(held) - past < ROWS:
            continue
        last = held.slice(len(held) - 1)
        here = pc.and_(pc.equal(held["list"], last["list"][0]), pc.equal(held["block"], last["block"][0]))
        begins = len(held) - pc.sum(here).as_py()
        if begins:
            yield near(held.slice(0, begins), past)
            held, past = held.slice(begins), 0
        elif pc.equal(last["role"][0], 1).as_py():  # all of the block's listed words are there
            yield near(held, past)
            held = held.filter(pc.equal(held["role"], 0))
            past = len(held)
    if held is not None and len(held):
        yield near(held, past)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of words (word, n), stored, that have a near one; form is that of largest n, then of least code points."""
    rows = lists(words).repartition("list", "block").sortWithinPartitions("list", "block", "role", "word")
    parts = rows.mapInArrow(walked, SIDE)
    best = F.min(F.struct((-F.col("form_n")).alias("k"), F.col("form").alias("form"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.k")).alias("form_n"), "best.form")


def group(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of docs (doc_id, text).

    Each form has TIMES its word's n, so chains of forms have 18 links at most; their ends are found by doubling.
    """
    words = stored(vocabulary(docs))
    is_form = F.col("form_n") >= TIMES * F.col("n")
    whole = words.join(neighbours(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(is_form, F.col(c)).alias(c) for c in ("form", "form_n")))
    whole = stored(whole)
    roots = stored(whole.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = stored(roots.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        discard(roots)
        roots = further
        if roots.where("moved").isEmpty():
            break
    return whole.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
