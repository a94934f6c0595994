"""Matching, edit distance, items and boxes against plain models."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docassay.functions import scores
from docassay.operators import blocking, boxes, fuzzy, matching


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a, b):
    n = max(len(a), len(b))
    return 1.0 if not n else 1 - distance(a, b) / n


def bounds(a, b):
    n = max(len(a), len(b))
    return (1.0, 1.0) if a == b else (min(len(a), len(b)) / n, sum((Counter(a) & Counter(b)).values()) / n)


def best(value, others, threshold):
    for k in (0, 1):  # by each bound in turn: stable order, least bound
        others = sorted((o for o in others if bounds(value, o)[k] >= threshold), key=lambda o: -bounds(value, o)[k])
    found = None
    for o in others:
        s = ratio(value, o)
        if s >= threshold and (found is None or s > found[1]):
            found = o, s
    return found


def model(left, right, threshold):
    left, right, out, without = list(left), list(right), [], []
    for x in left:
        b = best(x, right, threshold)
        if b:
            right.remove(b[0])
            out.append((x, *b))
        else:
            without.append(x)
    n = len(right)
    for x in without[:n]:
        b = best(x, right, 0.0)
        right.remove(b[0])
        out.append((x, *b))
    return out + [(x, "", 0.0) for x in without[n:]] + [("", y, 0.0) for y in right]


def test_greedy_as_the_model(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    rows = [([word() for _ in range(rng.randint(0, 6))], [word() for _ in range(rng.randint(0, 6))]) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e array<string>, a array<string>")
    got = df.select("i", matching.greedy(F.col("e"), F.col("a"), scores.levenshtein, 0.8).alias("p")).orderBy("i").collect()
    for g, (e, a) in zip(got, rows, strict=True):
        want = model(e, a, 0.8)
        assert [(p.e, p.a) for p in g.p] == [w[:2] for w in want]
        assert [p.score for p in g.p] == pytest.approx([w[2] for w in want])


def test_counts_of_matches(spark):
    df = spark.createDataFrame([(["a", "b1", "c1"], ["a", "c2"]), ([], []), (["x"], ["x"])], "e array<string>, a array<string>")
    p = matching.greedy(F.col("e"), F.col("a"), scores.exact, 1.0, bounded=False)
    got = df.select(matching.partial_counts(p, 1.0).alias("s"), matching.whole_score(F.col("e"), F.col("a"), p).alias("w"), matching.as_set(F.col("e")).alias("x")).collect()
    assert [(r.s.tp, r.s.fp, r.s.fn, r.s.tn, r.w) for r in got] == [(1, 1, 1, 0, 0.0), (0, 0, 0, 0, 1.0), (1, 0, 0, 0, 1.0)]


def test_edit_distance(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("ab", "abc"), ("bc", "abc")]
    for n in (5, 40, 600):
        for _ in range(8):
            a = "".join(rng.choice("abcdé") for _ in range(n))
            b = "".join(c if rng.random() > rng.choice([0.02, 0.9]) else rng.choice(["", "x", "yz"]) for c in a)
            pairs.append((a, b))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", scores.edit_distance(F.col("a"), F.col("b")).alias("d"), scores.char_count_bound(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [g.d for g in got] == [distance(*p) for p in pairs]
    assert [g.c for g in got] == pytest.approx([bounds(*p)[1] for p in pairs])


def test_items(spark):
    df = spark.createDataFrame([(["abc", "de"], ["abc de"]), (["abc"], ["abd"]), ([], []), (["a"], [""]), (["xyz abc"], ["xyz", "abc"])], "e array<string>, a array<string>")
    got = [r.s for r in df.select(matching.items_exact(F.col("e"), F.col("a")).alias("s")).collect()]
    assert got == pytest.approx([5 / 6, 0.0, 1.0, 0.0, 6 / 7])


def test_box_areas(spark):
    df = spark.createDataFrame([("1,0,0,10,10", "1,5,0,10,10"), ("1,0,0,10,10", "2,0,0,10,10"), ("1,0,0,2,2;1,4,0,0,2", "1,0,0,2,2")], "e string, a string")
    e, a = boxes.parse(F.col("e")), boxes.parse(F.col("a"))
    got = df.select(boxes.area_counts(e, a, 1).alias("s"), boxes.similarity(e, a).alias("m"), boxes.formatted(e).alias("f")).collect()
    assert [(r.s.tp, r.s.fp, r.s.fn) for r in got] == [(50, 50, 50), (0, 100, 100), (4, 0, 0)]
    assert [r.m for r in got] == [0.5, 0.0, 1.0] and got[2].f == "1,0.0,0.0,2.0,2.0"
    assert got[2].s.score == 1.0


def test_fuzzy_lists_as_the_model(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcAB ,") for _ in range(rng.randint(2, 16))) for _ in range(9)]
    ways = (str, str.lower, lambda x: x.replace(",", "") or "x", lambda x: x[: len(x) // 2 + 1], lambda x: x[::-1], lambda x: x[1:] + x[0])
    some = lambda: [rng.choice(ways)(rng.choice(base)) for _ in range(rng.randint(0, 9))]
    rows = [(some(), some()) for _ in range(400)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)] + [(-1, None, ["a"])], "key int, e array<string>, a array<string>")
    got = {r.key: r for r in fuzzy.scored(df).collect()}
    assert tuple(got.pop(-1)) == (-1, None, None, None, None, None)
    for k, (e, a) in enumerate(rows):
        pairs = model(e, a, 0.8)
        tp = sum(s >= 0.8 for _, _, s in pairs)
        want = (tp, len(a) - tp, max(len(e) - len(a), 0), 0)
        assert (got[k].tp, got[k].fp, got[k].fn, got[k].tn) == want
        assert got[k].score == pytest.approx(sum(s for *_, s in pairs) / len(pairs) if pairs else 1.0, abs=1e-12)
    tps = {r.key: r.tp for r in fuzzy.scored(df, rest=False).collect()}
    assert all(tps[k] == got[k].tp for k in got)


def test_many_lists_of_long_lines(spark):
    """3,000 documents of eight lines of some 700 characters, in lower case on the other side."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)).title() for _ in range(300)]
    rows = [(k, [" ".join(rng.choices(words, k=100)) for _ in range(8)]) for k in range(3_000)]
    df = spark.createDataFrame(rows, "key int, e array<string>").repartition(8).withColumn("a", F.reverse(F.transform("e", F.lower))).cache()
    df.count()
    began = time.time()
    for made in (blocking.counts(df), fuzzy.scored(df)):
        assert made.agg(F.sum("tp")).first()[0] == 24_000
    assert time.time() - began < 60
