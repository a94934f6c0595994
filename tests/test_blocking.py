"""Matching by blocks beside the fold that compares all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docassay.operators import blocking
from docassay.plans import registry

SF = "/root/testdata/sf0.001"


def first_pass(e, a, spark_scores):
    """Greedy by brute force: (i, j)."""
    left, made = dict(enumerate(a)), []
    for i, x in enumerate(e):
        good = [(*[-v for v in spark_scores(x, y)], j) for j, y in left.items() if spark_scores(x, y)[0] >= 0.8]
        if good:
            j = min(good)[-1]
            made.append((i, j))
            del left[j]
    return made


def similarity(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    n = max(len(x), len(y))
    shared = sum(min(x.count(c), y.count(c)) for c in set(x))
    return (1.0, 1.0, 1.0) if x == y else (1 - row[-1] / n, shared / n, min(len(x), len(y)) / n)


def test_as_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 14))) for _ in range(12)]
    change = lambda x: x if rng.random() < 0.4 else (x + rng.choice("abz") if rng.random() < 0.5 else x[: rng.randrange(len(x) + 1)] + "q" + x[rng.randrange(len(x)) :])
    rows = [([change(rng.choice(base)) for _ in range(rng.randint(0, 9))], [change(rng.choice(base)) for _ in range(rng.randint(0, 9))]) for _ in range(150)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "key int, e array<string>, a array<string>")
    got = {k: [] for k in range(len(rows))}
    for r in blocking.assigned(df).collect():
        got[r.key].append((r.i, r.j))
    assert {k: sorted(v) for k, v in got.items()} == {k: first_pass(*r, similarity) for k, r in enumerate(rows)}
    with pytest.raises(ValueError):
        blocking.links(df, 0.5)


def test_counts_are_those_of_the_fold(spark):
    lists = registry.queries()["score_fuzzy_counts"](spark, SF)
    fold = registry.queries()["score_partial_ulist_levenshtein"](spark, SF)
    both = lists.join(fold.select("doc_id", F.col("tp").alias("t"), F.col("fp").alias("f"), F.col("fn").alias("n")), "doc_id").collect()
    assert both and all((r.tp, r.fp, r.fn) == (r.t, r.f, r.n) for r in both)


def test_long_lists_and_many_copies(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(400)]
    values = [" ".join(rng.sample(words, 3)) for _ in range(9_000)] + ["the same value"] * 1_000
    other = [v + "x" for v in rng.sample(values, len(values))]
    df = spark.createDataFrame([(1, values, other), (2, [], ["a"]), (3, ["a"], [])], "key int, e array<string>, a array<string>")
    began = time.time()
    got = {r.key: (r.tp, r.fp, r.fn) for r in blocking.counts(df).collect()}
    assert got == {1: (10_000, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1)} and time.time() - began < 90


