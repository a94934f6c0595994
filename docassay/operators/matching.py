"""Unordered matching of two lists by any measure, one to one, within the row: no shuffle and no Python.

First each expected value, in order, takes the best actual value that is left and reaches the threshold. Then as
many of the expected values that went without as there are actual values left take the best of these, however
bad. Of equal scores the larger bounds win, then the earlier value. What stays over on either side is a miss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scores

Measure = Callable[[Column, Column], Column]
VALUE = "struct<i:int,v:string>"
PAIR = "struct<e:string,a:string,score:double>"
STATE = f"struct<rest:array<{VALUE}>,without:array<{VALUE}>,pairs:array<{PAIR}>>"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _state(rest: Column, without: Column, pairs: Column) -> Column:
    return F.struct(rest.alias("rest"), without.alias("without"), pairs.alias("pairs")).cast(STATE)


def _best(value: Column, rest: Column, measure: Measure, threshold: float, bounded: bool) -> Column:
    """The best of rest for value as struct(score, bounds, -i, v); null if none reaches the threshold."""

    def row(x: Column, score: Column, c: Column, n: Column) -> Column:
        return F.struct(score.cast("double").alias("score"), c.cast("double").alias("c"), n.cast("double").alias("l"), (-x["i"]).alias("n"), x["v"].alias("v"))

    one = F.lit(1.0)
    if not bounded:
        return F.array_max(F.filter(F.transform(rest, lambda x: row(x, measure(value, x["v"]), one, one)), lambda x: x["score"] >= threshold))
    near = F.filter(rest, lambda x: scores.length_bound(value, x["v"]) >= threshold)
    near = F.transform(near, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"), scores.char_count_bound(value, x["v"]).alias("c")))
    near = F.filter(near, lambda x: x["c"] >= threshold)
    made = F.transform(near, lambda x: row(x, measure(value, x["v"]), x["c"], scores.length_bound(value, x["v"])))
    best = F.array_max(F.filter(made, lambda x: x["score"] >= threshold))
    # Nothing is better than the first equal value, so the others needn't be measured.
    same = F.array_position(F.transform(rest, lambda x: x["v"]), value)
    return F.when(same > 0, _let(F.get(rest, same.cast("int") - 1), lambda x: row(x, one, one, one))).otherwise(best)


def _pass(values: Column, state: Column, measure: Measure, threshold: float, bounded: bool) -> Column:
    def step(s: Column, x: Column) -> Column:
        def taken(b: Column) -> Column:
            pair = F.struct(x["v"].alias("e"), b["v"].alias("a"), b["score"].alias("score"))
            with_ = _state(F.filter(s["rest"], lambda r: r["i"] != -b["n"]), s["without"], F.concat(s["pairs"], F.array(pair)))
            return F.when(b.isNull(), _state(s["rest"], F.concat(s["without"], F.array(x)), s["pairs"])).otherwise(with_)

        return _let(_best(x["v"], s["rest"], measure, threshold, bounded), taken)

    return F.aggregate(values, state, step)


def greedy(expected: Column, actual: Column, measure: Measure, threshold: float, bounded: bool = True) -> Column:
    """array<struct<e, a, score>>: pairs, then expected values alone, then actual values alone, with score 0.

    `bounded` says that no score is above the length and character bounds, as for edit similarities.
    """

    def numbered(xs: Column) -> Column:
        return F.transform(xs, lambda v, i: F.struct(i.alias("i"), v.alias("v"))).cast(f"array<{VALUE}>")

    none = F.array().cast(f"array<{VALUE}>")
    first = _pass(numbered(expected), _state(numbered(actual), none, F.array().cast(f"array<{PAIR}>")), measure, threshold, bounded)

    def second(s: Column) -> Column:
        n = F.size(s["rest"])
        tried = F.when(n > 0, F.slice(s["without"], F.lit(1), n)).otherwise(none)
        left = F.when(n > 0, F.slice(s["without"], n + 1, F.greatest(F.size(s["without"]) - n, F.lit(0)))).otherwise(s["without"])
        return _pass(tried, _state(s["rest"], left, s["pairs"]), measure, 0.0, bounded)

    def alone(s: Column) -> Column:
        def over(side: str, e: Callable[[Column], Column], a: Callable[[Column], Column]) -> Column:
            return F.transform(s[side], lambda x: F.struct(e(x).alias("e"), a(x).alias("a"), F.lit(0.0).alias("score"))).cast(f"array<{PAIR}>")

        value, empty = (lambda x: x["v"]), (lambda x: F.lit(""))
        return F.concat(s["pairs"], over("without", value, empty), over("rest", empty, value))

    return _let(_let(first, second), alone)


def _numbered(xs: Column, side: int, prepare: Callable[[Column], Column]) -> Column:
    """Values (p, k, side, i) by prepared value p and place i; k numbers equal values."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i - 1)["p"] != F.get(s, i)["p"]))
        sized = _let(starts, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s))), lambda x, y: F.sequence(F.lit(0), y - x - 1)))
        k = F.when(F.size(s) > 0, F.flatten(sized)).otherwise(F.array().cast("array<int>"))
        return F.zip_with(s, k, lambda x, n: F.struct(x["p"].alias("p"), n.alias("k"), F.lit(side).alias("side"), x["i"].alias("i")))

    return _let(F.sort_array(F.transform(xs, lambda v, i: F.struct(prepare(v).alias("p"), i.alias("i")))), runs)


def greedy_equal(expected: Column, actual: Column, prepare: Callable[[Column], Column] = lambda x: x) -> Column:
    """greedy() for measures that are 1 for values that are equal once prepared, else 0: the nth of equal values goes with the other side's nth.

    Both sides are sorted together, so that such values are neighbours: time grows with the sort's.
    """

    def matched(v: Column) -> Column:
        def beside(both: Column) -> Column:
            same = lambda x, j: F.coalesce((F.get(both, j)["p"] == x["p"]) & (F.get(both, j)["k"] == x["k"]), F.lit(False))
            mark = F.transform(both, lambda x, j: F.struct(x["side"].alias("side"), x["i"].alias("i"), F.when(x["side"] == 0, F.when(same(x, j + 1), F.get(both, j + 1)["i"])).when((j > 0) & same(x, j - 1), F.lit(-1)).alias("of")))
            return mark

        def listed(m: Column) -> Column:
            blank = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(""))
            pairs = F.sort_array(F.transform(F.filter(m, lambda x: (x["side"] == 0) & x["of"].isNotNull()), lambda x: F.struct(x["i"].alias("i"), x["of"].alias("of"))))
            left = [F.sort_array(F.transform(F.filter(m, lambda x: (x["side"] == side) & x["of"].isNull()), lambda x: x["i"])) for side in (0, 1)]  # noqa: B023
            found = F.transform(pairs, lambda x: F.struct(F.get(v["e"], x["i"]).alias("e"), F.get(v["a"], x["of"]).alias("a"), F.lit(1.0).alias("score")))
            # what is left is paired in order, at 0; the longer side's rest stays alone
            rest = F.zip_with(left[0], left[1], lambda i, j: F.struct(blank(v["e"], i).alias("e"), blank(v["a"], j).alias("a"), F.lit(0.0).alias("score")))
            return F.concat(found.cast(f"array<{PAIR}>"), rest.cast(f"array<{PAIR}>"))

        both = F.sort_array(F.concat(_numbered(v["e"], 0, prepare), _numbered(v["a"], 1, prepare)))
        return _let(_let(both, beside), listed)

    return _let(F.struct(expected.alias("e"), actual.alias("a")), matched)


def partial_counts(pairs: Column, threshold: float) -> Column:
    """tp, fp, fn, tn summed over matched pairs, and the mean score; 1 without pairs."""

    def count(c: str) -> Column:
        return F.size(F.filter(pairs, lambda p: scores.confusion(p["e"], p["a"], p["score"], threshold)[c] == 1)).cast("long").alias(c)

    mean = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["score"]) / F.size(pairs)
    return F.struct(*map(count, ("tp", "fp", "fn", "tn")), F.when(F.size(pairs) == 0, 1.0).otherwise(mean).alias("score"))


def whole_score(expected: Column, actual: Column, pairs: Column) -> Column:
    """The mean score of the pairs if the lists are equally long, else 0; 1 if both are empty."""
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["score"]) / F.size(pairs)
    return F.when(F.size(expected) != F.size(actual), 0.0).when(F.size(pairs) == 0, 1.0).otherwise(mean)


def as_set(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def items_covered(haystack: Column, needles: Column) -> Column:
    """Share of the characters of the items of haystack, joined with blanks, that the first occurrences of the needles cover.

    One place for each item but the last is not counted: that after its length, from the start of the text. Occurrences
    are intervals, summed up in one sweep from left to right.
    """
    some = lambda xs: F.filter(xs, lambda x: x != "")

    def of(v: Column) -> Column:
        spans = F.transform(v["n"], lambda x: F.struct(F.position(x, v["text"]).alias("s"), (F.position(x, v["text"]) + F.char_length(x)).alias("e")))
        skipped = F.array_distinct(F.transform(F.slice(v["h"], F.lit(1), F.greatest(F.size(v["h"]) - 1, F.lit(0))), lambda x: F.char_length(x) + 1))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

        def swept(z: Column) -> Column:
            step = lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("total"))
            covered = F.aggregate(z["spans"], start, step, lambda acc: acc["total"])
            lost = F.size(F.filter(z["skipped"], lambda p: F.exists(z["spans"], lambda x: (x["s"] <= p) & (p < x["e"]))))
            return (covered - lost) / (F.char_length(v["text"]) - F.size(z["skipped"]))

        found = F.sort_array(F.filter(spans, lambda x: x["s"] > 0))
        share = _let(F.struct(found.alias("spans"), skipped.alias("skipped")), swept)
        none = (F.size(v["h"]) == 0) | (F.size(v["n"]) == 0)
        return F.when(none, ((F.size(v["h"]) == 0) & (F.size(v["n"]) == 0)).cast("double")).otherwise(share)

    return _let(_let(F.struct(some(haystack).alias("h"), some(needles).alias("n")), lambda v: F.struct(v["h"].alias("h"), v["n"].alias("n"), F.array_join(v["h"], " ").alias("text"))), of)


def items_exact(expected: Column, actual: Column) -> Column:
    """Items of the side with fewer of them are searched for those of the other."""
    fewer = F.size(expected) >= F.size(actual)
    return _let(F.struct(F.when(fewer, actual).otherwise(expected).alias("h"), F.when(fewer, expected).otherwise(actual).alias("n")), lambda v: items_covered(v["h"], v["n"]))
