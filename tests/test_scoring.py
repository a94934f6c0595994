"""Scoring types, the fan-out over fields, and summaries against plain models."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_matching import model, ratio

from docassay.functions import scores, text
from docassay.operators import box_lists, boxes, details, lists, scoring, summary

LIMITS = {"exact": 1.0, "soft": 1.0, "levenshtein": 0.8}


def plain(x):
    return "".join(c for c in x if c not in text.IGNORED)


def measure(method, prepared):
    prepare = plain if method == "soft" and prepared else str
    return lambda a, b: ratio(a, b) if method == "levenshtein" else float(prepare(a) == prepare(b))


def counts(e, a, score, limit):
    tp = bool(e and a and score >= limit)
    return [int(tp), int(not tp and bool(a)), int(bool(e) and not a), int(not e and not a)]


def unordered(e, a, method):
    """(e, a, score) of the pairs, for methods whose ties are broken by place."""
    if method == "levenshtein":
        return model(e, a, 0.8)
    of, rest, out, without = measure(method, True), list(a), [], []
    for x in e:
        got = next((y for y in rest if of(x, y) == 1), None)
        if got is None:
            without.append(x)
        else:
            rest.remove(got)
            out.append((x, got, 1.0))
    n = min(len(rest), len(without))
    return out + [(x, y, 0.0) for x, y in zip(without, rest)] + [(x, "", 0.0) for x in without[n:]] + [("", y, 0.0) for y in rest[n:]]


def mean(xs):
    return sum(xs) / len(xs) if xs else 1.0


def in_list(e, a, method, limit):
    if len(e) != len(a):
        return 0.0
    each = [measure(method, False)(x, y) for x, y in zip(e, a)]
    return 0.0 if any(s < limit for s in each) else mean(each)


def whole_table(e, a, method, limit):
    """Counts and score of two tables' rows."""
    if not e and not a:
        return [*counts("", "", 1.0, 1.0), 1.0]
    if len(e) != len(a) or any(len(x) != len(y) for x, y in zip(e, a)):
        return [*counts("x" * bool(e), "x" * bool(a), 0.0, 1.0), 0.0]
    cells = [x for r in e for x in r], [x for r in a for x in r]
    score = in_list(*cells, method, limit)
    return [*counts(", ".join(cells[0]), ", ".join(cells[1]), score, limit), score]


def expected_score(e, a, kind, method, lower=False):
    """[tp, fp, fn, tn, score] as the rules say it."""
    limit = LIMITS[method]
    clean = lambda x: re.sub(r"\s+", " ", x or "").lower() if lower else re.sub(r"\s+", " ", x or "")
    if "table" in kind:
        e, a = ([[[clean(c) for c in r] for r in t["head"] + t["body"]] for t in x or []] for x in (e, a))
        if kind == "table":
            each = [whole_table(x, y, method, limit)[4] for x, y in zip(e, a)]
            score = 0.0 if len(e) != len(a) or any(s < limit for s in each) else mean(each)
            return [*counts("x" * bool(e), "x" * bool(a), score, limit), score]
        n = max(len(e), len(a))
        rows = [whole_table(*(x[i] if i < len(x) else [] for x in (e, a)), method, limit) for i in range(n)]
        return [*(sum(r[k] for r in rows) for k in range(4)), mean([r[4] for r in rows])]
    e, a = ([clean(x) for x in xs or []] for xs in (e, a))
    said = lambda x: ", ".join(x)
    if kind == "string":
        x, y = (plain("".join(v)) if method == "soft" else "".join(v) for v in (e, a))
        s = measure(method, False)(x, y)
        return [*counts(x, y, s, limit), s]
    if kind == "list":
        s = in_list(e, a, method, limit)
        return [*counts(said(e), said(a), s, limit), s]
    if kind == "partial_list":
        n = max(len(e), len(a))
        pairs = [(*(v[i] if i < len(v) else "" for v in (e, a)),) for i in range(n)]
        rows = [[*counts(x, y, measure(method, False)(x, y), limit), measure(method, False)(x, y)] for x, y in pairs]
        return [*(sum(r[k] for r in rows) for k in range(4)), mean([r[4] for r in rows])]
    if "set" in kind:
        e, a = sorted(set(e)), sorted(set(a))
    pairs = unordered(e, a, method)
    s = mean([p[2] for p in pairs])
    if kind.startswith("partial"):
        rows = [counts(*p, limit) for p in pairs]
        return [*(sum(r[k] for r in rows) for k in range(4)), s]
    s = 0.0 if len(e) != len(a) else s
    return [*counts(said(e), said(a), s, limit), s]


def test_types_against_the_model(spark):
    own = random.Random(4)
    word = lambda: own.choice(["", "a", "A b", "a  b", "a-b", "ab", "long name one", "long name two", "lung name one", "é", "x\ty"])
    some = lambda: own.choice([None, [], *[[word() for _ in range(own.randrange(6))] for _ in range(9)]])
    rows = [(i, some(), some()) for i in range(150)]
    rows += [(200 + i, e, list(e)) for i, (_, e, _) in enumerate(rows[:40]) if e is not None]
    df = spark.createDataFrame(rows, "i int, e array<string>, a array<string>").cache()
    for kind in scoring.TYPES:
        cases = [(m, lower) for m in LIMITS for lower in (False, True)]
        got = df.select("i", *(scoring.score(F.col("e"), F.col("a"), kind, m, lower).alias(f"{m}_{lower}") for m, lower in cases)).collect()
        for r in got:
            _, e, a = next(x for x in rows if x[0] == r.i)
            for m, lower in cases:
                s = r[f"{m}_{lower}"]
                want = expected_score(e, a, kind, m, lower)
                assert [s.tp, s.fp, s.fn, s.tn] == want[:4] and s.score == pytest.approx(want[4]), (kind, m, lower, e, a)


def test_tables_against_the_model(spark):
    own = random.Random(7)
    cells = lambda: [own.choice(["a", "b", "long cell", "lang cell", ""]) for _ in range(own.choice([1, 2, 2, 2]))]
    part = lambda: [cells() for _ in range(own.randrange(3))]
    tables = lambda: own.choice([None, *[[{"head": part(), "body": part()} for _ in range(own.randrange(3))] for _ in range(6)]])
    rows = [(i, *(lambda e: (e, e if own.random() < 0.4 else tables()))(tables())) for i in range(120)]
    kind = "array<struct<head:array<array<string>>,body:array<array<string>>>>"
    df = spark.createDataFrame([(i, *([(t["head"], t["body"]) for t in x] if x is not None else None for x in (e, a))) for i, e, a in rows], f"i int, e {kind}, a {kind}")
    made = df.select("i", *(scoring.score(F.col("e"), F.col("a"), k, m).alias(f"{k}-{m}") for k in scoring.TABLE_TYPES for m in LIMITS)).collect()
    for r in made:
        _, e, a = rows[r.i]
        for k in scoring.TABLE_TYPES:
            for m in LIMITS:
                s, want = r[f"{k}-{m}"], expected_score(e, a, k, m)
                assert [s.tp, s.fp, s.fn, s.tn] == want[:4] and s.score == pytest.approx(want[4]), (k, m, e, a)


def test_unknown_names():
    with pytest.raises(ValueError):
        scoring.score(F.lit(1), F.lit(1), "bag", "exact")
    with pytest.raises(ValueError):
        scoring.score(F.lit(1), F.lit(1), "list", "vague")
    with pytest.raises(KeyError):
        scoring.score_custom(None, [], [{"type": "none"}])


def test_fan_out(spark):
    rows = [(1, {"title": ["A"], "names": ["x", "y"], "more": ["m"]}, {"title": ["a"], "names": ["y", "x"]}), (2, {"title": []}, {"title": ["B"], "names": []}), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, expected map<string,array<string>>, actual map<string,array<string>>")
    seen = Observation("fields")
    types = {"default": ["string"], "names": ["list", "partial_ulist"]}
    made = scoring.score_documents(df, ["id"], None, types, ["exact", "soft"], lower=True, counters=seen)
    got = {(r.id, r.field_name, r.scoring_type, r.scoring_method): (r.tp, r.fp, r.fn, r.tn) for r in made.collect()}
    assert seen.get == {"fields": 4, "errors": 1} and len(got) == 8
    assert got[1, "title", "string", "exact"] == (1, 0, 0, 0) and got[2, "title", "string", "soft"] == (0, 1, 0, 0)
    assert got[1, "names", "list", "exact"] == (0, 1, 0, 0) and got[1, "names", "partial_ulist", "soft"] == (2, 0, 0, 0)
    with pytest.raises(Exception, match="field missing in prediction: more"):
        scoring.score_documents(df, ["id"], None, types, ["exact"], skip_errors=False).collect()
    only = scoring.score_documents(df, ["id"], ["names", "none"], types, ["exact"])
    assert {r.field_name for r in only.collect()} == {"names"}
    flat = details.flatten_details(made.withColumns({"prediction_file": F.lit("p/x"), "target_file": F.lit("t/x")}))
    assert flat.where("scoring_type = 'partial_ulist'").count() == 4


def test_sides_joined(spark):
    schema = "id int, field_name string, values array<string>"
    e, a = spark.createDataFrame([(1, "t", ["a"]), (1, "u", ["b"])], schema), spark.createDataFrame([(1, "t", ["a"]), (2, "t", ["z"])], schema)
    got = {r.field_name: r for r in scoring.join_sides(e, a, ["id"]).collect()}
    assert got["t"].error is None and got["t"].actual == ["a"] and got["u"].error and len(got) == 2


def test_custom_boxes(spark):
    df = spark.createDataFrame([(1, {"a": ["1,0,0,10,10"], "b": ["1,20,0,10,10"]}, {"a": ["1,20,0,10,10", "1,0,0,10,10"]}), (2, {"a": [""]}, {})], "id int, expected map<string,array<string>>, actual map<string,array<string>>")
    fields = {"field_names": ["a", "b"]}
    custom = [{"name": "m", "type": "bounding_box_intersection", "expected": fields, "actual": fields}, {"name": "s", "type": "bounding_box_intersection_area", "expected": fields, "actual": fields, "config": {"resolution": 1}}]
    got = {(r.id, r.field_name): (r.tp, r.fp, r.fn, r.score) for r in scoring.score_custom(df, ["id"], custom).collect()}
    assert got[1, "m"] == (2, 0, 0, 1.0) and got[1, "s"] == (200, 0, 0, 1.0) and got[2, "s"] == (0, 0, 0, 0.0) and got[2, "m"][:3] == (0, 0, 0)


def test_summary_by_type_with_empty_groups_and_order(spark):
    rows = [("list", "exact", "title", 6, 4, 0), ("list", "exact", "abstract", 1, 0, 2), ("set", "exact", "other", 1, 1, 1)]
    df = spark.createDataFrame(rows, "scoring_type string, scoring_method string, field_name string, tp long, fp long, fn long")
    made = [(r.scoring_type, r.stats_name, r.field_name, r.tp, r.tn, r.f1) for r in summary.in_order(summary.summary(df, ["title", "abstract"]), ["title", "abstract"]).collect()]
    assert [m[:3] for m in made] == [("list", "by-field", "title"), ("list", "by-field", "abstract"), ("list", "micro", None), ("list", "macro", None), ("set", "micro", None), ("set", "macro", None)]
    total = 6 + 1 + 2 + 8
    assert [m[4] for m in made[:2]] == [total - 10, total - 1 - 2] and made[2][3] == 7 and made[4][3:] == (0, 0, 0) and made[5][5] == 0


def test_nulls_and_empties(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    assert [one(c) for c in scores.confusion(none, F.lit("a"), F.lit(0.0), 1.0).values()] == [0, 1, 0, 0]
    assert one(lists.list_score(F.lit(None).cast("array<string>"), empty)) == 1 and one(lists.partial_list_counts(F.lit(None).cast("array<string>"), empty)).score == 1
    assert one(boxes.parse(F.lit(""))) == one(boxes.parse(none)) == []
    with pytest.raises(Exception, match="five numbers"):
        one(boxes.parse(F.lit("1,2,3")))
    items = spark.createDataFrame([("k", None, None), ("l", "expected", "x")], "key string, side string, item string")
    assert {r.key: (r.tp, r.score) for r in lists.unordered_counts(items).collect()} == {"k": (0, 1.0), "l": (0, 0.0)}
    assert {r.key: r.score for r in lists.unordered_whole(items).collect()} == {"k": 1.0, "l": 0.0}
    assert one(scores.is_close(F.lit(1.0), F.lit(1.000001))) and not one(scores.is_close(F.lit(1.0), F.lit(1.1)))


def test_tools(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 1, 1), ("a", 2, 0)], "tool string, id int, tp int")
    assert sorted((r.tool, r.tool_other, r.tp, r.tp_other) for r in details.tool_pairs(df, ["id"]).collect()) == [("a", "b", 1, 0), ("a", "c", 1, 1), ("b", "c", 0, 1)]
    assert {(r.id, r.tool) for r in details.first_per_group(df, "id", "tool", "tp").collect()} == {(1, "b"), (2, "a")}


def test_summaries_of_batches(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["string", "list"]), "exact", rng.choice("abc"), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(200)]
    whole = spark.createDataFrame(rows, "scoring_type string, scoring_method string, field_name string, tp long, fp long, fn long").withColumn("batch", F.pmod(F.xxhash64("field_name", "tp"), F.lit(3)))
    states = [summary.state(whole.where(F.col("batch") == k)) for k in range(3)]
    order = lambda df: sorted(map(str, df.withColumns({m: F.round(m, 9) for m in summary.METRICS}).select(sorted(df.columns)).collect()))
    for names in (None, ["a", "c"]):
        assert order(summary.summary(summary.merged(*states), names)) == order(summary.summary(whole, names))


def test_overlap_sums(spark, monkeypatch):
    """Counts and areas as those of the join, also without the grid of ranks."""
    rng = random.Random(7)
    box = lambda: (rng.randrange(2), rng.choice([rng.randrange(-40, 40), 8.5]), rng.randrange(-30, 30) + 0.25, rng.choice([1, 2, 4, 0.5, 60, 0]), rng.choice([1, 3, 16, 50]))
    columns = "page int, x double, y double, w double, h double, id int"
    left, right = (spark.createDataFrame([(page, *map(float, rest), i % 250) for i, (page, *rest) in enumerate(box() for _ in range(300))] + [(0, None, 1.0, 5.0, 5.0, 0)], columns) for _ in "lr")
    want = {(r.id, r.n, r.area) for r in boxes.overlapping(left, right, ["page"]).groupBy("id").agg(F.count("*").alias("n"), F.sum("area").alias("area")).collect()}
    got = boxes.overlap_sums(left, right.drop("id"), ["page"], ["id"])
    assert {(r.id, r.n, r.area) for r in got.collect()} == want and len(want) > 200
    assert not boxes.overlap_sums(left, right.drop("id").where("page > 5"), ["page"], ["id"]).collect()
    sides = [[np.array(c, dtype=float) for c in zip(*[(x, y, x + w, y + h) for _, x, y, w, h in (box() for _ in range(200)) if w], strict=True)] for _ in range(2)]
    grid = boxes._sums(*sides)
    monkeypatch.setattr(boxes, "GRID", 0)
    by_bits = boxes._sums(*sides)
    assert all(np.array_equal(a, b) for a, b in zip(grid, by_bits, strict=True))


def test_overlaps_of_crowded_pages(spark):
    """50,000 boxes on each side that overlap nearly all: 2.5 billion pairs."""
    side = spark.range(50_000).select(F.lit(0).alias("page"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"), F.lit(100.0).alias("w"), F.lit(100.0).alias("h"), "id")
    row = boxes.overlap_sums(side, side.drop("id"), ["page"], ["id"]).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert (row.rows, row.n) == (50_000, 50_000**2)


def test_counts_without_details(spark):
    """Those of the columns, for all types of texts and both equality methods."""
    rng = random.Random(13)
    values = ["", "a", "A", "a.", ".", "b  c", "b c", " ", " ", "d e", "-", None]
    some = lambda: None if rng.random() < 0.05 else [rng.choice(values) for _ in range(rng.choice([0, 1, 2, 3, 5, 8]))]
    rows = [(k, rng.choice("fg"), some(), some()) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, field_name string, expected array<string>, actual array<string>")
    types = {"default": ["string", "str", "list", "partial_list", "ulist"], "g": ["partial_ulist", "set", "partial_set", "list"]}
    columns = ["k", "field_name", "scoring_type", "scoring_method", "tp", "fp", "fn", "tn", "score"]
    for lower in (False, True):
        one, other = (scoring.score_fields(df, types, ("exact", "soft"), lower, details=d).select(*columns) for d in (False, True))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() > 2000
    assert one.schema.simpleString() == other.schema.simpleString()


def test_fan_out_of_many_documents(spark):
    """20,000 documents of ten lines by all seven types."""
    line = F.concat_ws(" ", *(F.md5(F.concat(F.col("id"), F.lit(f" {k}"))) for k in range(6)))
    e = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(line, F.lit(" "), k.cast("string")))
    df = spark.range(0, 20_000, 1, 8).select("id", F.lit("f").alias("field_name"), e.alias("expected"), F.reverse(e).alias("actual"))
    began = time.time()
    kinds = ["string", "list", "partial_list", "ulist", "partial_ulist", "set", "partial_set"]
    assert scoring.score_fields(df, {"default": kinds}, ("exact", "soft"), details=False).agg(F.sum("tp")).first()[0] == 20_000 * 2 * 22
    assert time.time() - began < 20


def test_custom_boxes_without_details(spark, monkeypatch):
    """Those of the columns, also where rows have more pairs than are worked out at once."""
    rng = random.Random(14)
    box = lambda: ",".join(map(str, (rng.randint(1, 2), rng.randint(0, 3) / 8, rng.randint(0, 3) / 8, *rng.choices([0, 0.25, 0.375, 0.5], k=2))))
    value = lambda: rng.choice([None, "", ";", *(";".join(box() for _ in range(n)) for n in (1, 1, 1, 1, 1, 2, 3))])
    side = lambda: {f: [value() for _ in range(rng.choice([0, 1, 2, 4, 7]))] for f in rng.sample("fgh", rng.randint(0, 3))}
    df = spark.createDataFrame([(k, side(), side()) for k in range(300)], "k int, expected map<string,array<string>>, actual map<string,array<string>>")
    names = {"field_names": ["f", "g"]}
    custom = [{"name": f"x_{kind}", "type": kind, "expected": names, "actual": names} for kind in ("bounding_box_intersection", "bounding_box_intersection_area")]
    custom += [{**custom[1], "name": "y", "config": {"resolution": 3}, "expected": {"field_names": ["h"]}}, {**custom[0], "name": "z", "actual": {"field_names": ["h"]}}]
    columns = ["k", "field_name", "scoring_type", "scoring_method", "tp", "fp", "fn", "tn", "score"]
    want = sorted(map(tuple, scoring.score_custom(df, ["k"], custom).select(*columns).collect()))
    made = scoring.score_custom(df, ["k"], custom, details=False)
    assert sorted(map(tuple, made.select(*columns).collect())) == want and len(want) == 1200
    shared = df.select("k", *(F.coalesce(F.try_element_at(c, F.lit("f")), F.array()).alias(c[0]) for c in ("expected", "actual"))).orderBy("k").select("k", *(c for n in "ea" for c in (F.transform(n, boxes.parse).alias(n), F.transform(n, lambda x: F.coalesce(x, F.lit("")) != "").alias(f"{n}_some")))).toArrow().combine_chunks().to_batches()[0]
    e, a = (box_lists._Side(shared.column(n), shared.column(f"{n}_some")) for n in "ea")
    whole = box_lists._matched(e, a, 0.8), box_lists._areas(e, a, 1000.0)
    for pairs in (1, 7, 40):
        monkeypatch.setattr(box_lists, "PAIRS", pairs)
        assert (box_lists._matched(e, a, 0.8), box_lists._areas(e, a, 1000.0)) == whole
