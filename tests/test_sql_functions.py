"""Functions in SQL beside those of columns, own methods, and the join of boxes beside brute force."""

import random

import pytest
from pyspark.sql import functions as F

from docassay.functions import scores, sql, text
from docassay.operators import boxes, scoring


def test_functions_in_sql(spark):
    sql.register(spark)
    rows = [("a b", "ab"), ("a\n  b", "a b"), ("", ""), (None, None), ("x", None), ("“é”, x", "éx"), ("abc", "abd")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    df.createOrReplaceTempView("sides")
    got = spark.sql("SELECT normalize_whitespace(a) n, strip_punctuation(a) s, score_exact(a, b) e, score_soft(a, b) o, score_levenshtein(a, b) l, match_kind(a, b, score_exact(a, b), 1D) k FROM sides ORDER BY i").collect()
    a, b = F.col("a"), F.col("b")
    counts = scores.confusion(a, b, scores.exact(a, b), 1.0)
    kind = F.coalesce(*(F.when(c == 1, n) for n, c in counts.items()))
    want = df.orderBy("i").select(text.normalize_whitespace(a), text.strip_punctuation(a), scores.exact(a, b), scores.soft(a, b), scores.levenshtein(a, b), kind).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    with pytest.raises(ValueError):
        sql.define(spark, "bad name", "a INT", "INT", "a")


def test_own_method(spark):
    scoring.add_method("start", sql.measure("startswith"), 1.0)
    try:
        pairs = spark.createDataFrame([(1, {"f": ["abc", "x"]}, {"f": ["ab", "y"]})], "id int, expected map<string,array<string>>, actual map<string,array<string>>")
        row = scoring.score_documents(pairs, ["id"], None, {"f": ["partial_list"]}, ("start",)).first()
        assert (row.tp, row.fp, row.score) == (1, 1, 0.5)
        with pytest.raises(ValueError):
            scoring.add_method("start", sql.measure("startswith"), 1.0)
    finally:
        del scoring.METHODS["start"]


def test_overlapping_boxes(spark):
    rng = random.Random(5)

    def box(i):
        size = rng.choice([0.5, 3, 20, 700])
        return (i, rng.choice("pq"), rng.uniform(-50, 900), rng.uniform(0, 900), rng.uniform(0, size), rng.uniform(-1, size))

    one, two = [box(i) for i in range(150)], [box(i) for i in range(200)] + [(999, None, 0.0, 0.0, 5.0, 5.0), (998, "p", None, 0.0, 5.0, 5.0)]
    kind = "id int, page string, x double, y double, w double, h double"
    got = boxes.overlapping(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), ["page"], 2.0).collect()
    want = {}
    for i, p, x, y, w, h in one:
        for j, q, x2, y2, w2, h2 in two:
            if p == q and x2 is not None:
                a, b = min(x + w, x2 + w2) - max(x, x2), min(y + h, y2 + h2) - max(y, y2)
                if a > 0 and b > 0 and h > 0 and h2 > 0:
                    want[i, j] = a * b
    assert len(got) == len(want) and {(r.id, r.id_other): r.area for r in got} == pytest.approx(want)
    none = spark.createDataFrame([], kind)
    assert boxes.overlapping(none, none, ["page"]).count() == 0
