"""Unordered matching of long lists by edit similarity: only values that can reach the threshold are compared.

Values are taken once for each list and side. Each has its 3-grams, numbered where they repeat; two values of a
similarity of t or more share so many that their rarest ones, as many as the prefix filter asks for, have one in
common. A join on list and gram gives the candidates, bounds of lengths and characters and the distance itself leave the
links. The assignment then goes through each list's links in the order of the expected values, in one task a list, with
memory for its values and links.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.stored import stored
from .fuzzy import scored
from .matching import _numbered
from .paths import let

#: Pairs of a list's values up to which it is matched in its row.
PAIRS = 4_000_000

#: Characters of a gram, and what stands before and behind a value, so that each character is in as many grams.
Q, EDGE = 3, "\x02"


def _grams(v: Column) -> Column:
    edge = [F.lit(EDGE)] * (Q - 1)
    chars = F.concat(F.array(*edge), F.split(v, ""), F.array(*edge))
    every = let(F.when(v == "", F.array(*edge, *edge)).otherwise(chars), lambda c: F.transform(F.slice(c, Q, F.size(c)), lambda _, i: F.concat(*(F.get(c, i + k) for k in range(Q)))))
    return F.transform(_numbered(every, 0, lambda x: x), lambda x: F.concat(x["p"], x["k"].cast("string")))


def links(values: DataFrame, threshold: float = scores.THRESHOLDS["levenshtein"]) -> DataFrame:
    """(key, e, a, score, c, l): all pairs of expected and actual values of a list, from (key, side, id, v), whose edit similarity is at least threshold, by id, with its bounds.

    One edit takes Q grams at most, so threshold must be over 1 - 1 / Q. values must be stored: it is read several
    times. Grams go without their values, which are joined to the candidates.
    """
    if not 1 - 1 / Q < threshold <= 1:
        raise ValueError(f"the threshold must be over {1 - 1 / Q:.3f}, and 1 at most: {threshold}")
    grams = values.select("key", "side", "id", F.char_length("v").alias("size"), F.explode(_grams(F.col("v"))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    prefix = F.floor(Q * (1 - threshold) * F.col("size") + 1e-9) + 1
    place = F.row_number().over(Window.partitionBy("key", "side", "id").orderBy("often", "gram"))
    rare = stored(grams.join(often, "gram").withColumn("place", place).where(F.col("place") <= prefix).drop("place", "often"))
    side = lambda name: rare.where(F.col("side") == name).select("key", "gram", F.col("id").alias(name[0]), F.col("size").alias(f"{name[0]}_size"))
    fits = F.least("e_size", "a_size") >= threshold * F.greatest("e_size", "a_size") - 1e-9
    both = side("expected").join(side("actual"), ["key", "gram"]).where(fits).select("key", "e", "a").distinct()
    text = lambda name: values.where(F.col("side") == name).select("key", F.col("id").alias(name[0]), F.col("v").alias(f"{name[0]}_text"))
    both = both.join(text("expected"), ["key", "e"]).join(text("actual"), ["key", "a"])
    e, a = F.col("e_text"), F.col("a_text")
    longest = F.greatest(F.char_length(e), F.char_length(a))
    most = F.floor((1 - threshold) * longest + 1e-9).cast("int")  # edits; beyond them the distance is given up
    near = both.withColumn("d", F.call_function("levenshtein", e, a, most)).where("d >= 0")
    measured = near.select("key", "e", "a", F.when(longest == 0, 1.0).otherwise(1 - F.col("d") / longest).alias("score"), scores.char_count_bound(e, a).alias("c"), scores.length_bound(e, a).alias("l"))
    return measured.where(F.col("score") >= threshold)


def _assigned(rows: pd.DataFrame) -> list[tuple[int, int, float]]:
    """(i, j, score): each expected value in order takes the best actual value that is left; of equal scores larger bounds win, then the earlier value."""
    near, free, asks = defaultdict(list), {}, []
    for r in rows.itertuples(index=False):
        if r.kind == "link":
            near[r.id].append((-r.score, -r.c, -r.l, r.w))
        elif r.kind == "actual":
            free[r.id] = sorted(r.places, reverse=True)
        else:
            asks += [(i, r.id) for i in r.places]
    for links_ in near.values():
        links_.sort()
    made = []
    for i, v in sorted(asks):
        best, taken = None, None
        for s, c, n, w in near[v]:
            if best is not None and (s, c, n) != best:
                break
            if free.get(w) and (taken is None or free[w][-1] < free[taken][-1]):
                best, taken = (s, c, n), w
        if taken is not None:
            made.append((i, free[taken].pop(), -best[0]))
    return made


def assigned(lists: DataFrame, threshold: float = scores.THRESHOLDS["levenshtein"]) -> DataFrame:
    """(key, i, j, score): places of the values of lists (key, e, a) that are matched by edit similarity, threshold at least."""
    each = [lists.select("key", F.lit(name).alias("side"), F.posexplode(name[0]).alias("i", "v")) for name in ("expected", "actual")]
    values = each[0].unionByName(each[1]).groupBy("key", "side", "v").agg(F.collect_list("i").alias("places"))
    places = stored(values.withColumn("id", F.array_min("places")))  # a value is known by its first place
    found = links(places.select("key", "side", "id", "v"), threshold)
    empty = lambda kind: F.lit(None).cast(kind)
    rows = places.select("key", F.col("side").alias("kind"), "id", "places", empty("int").alias("w"), *(empty("double").alias(c) for c in ("score", "c", "l")))
    rows = rows.unionByName(found.select("key", F.lit("link").alias("kind"), F.col("e").alias("id"), empty("array<int>").alias("places"), F.col("a").alias("w"), "score", "c", "l"))
    kind = lists.schema["key"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        made = _assigned(part)
        return pd.DataFrame({"key": [key[0]] * len(made), "i": [m[0] for m in made], "j": [m[1] for m in made], "score": [m[2] for m in made]})

    return rows.groupBy("key").applyInPandas(run, f"key {kind}, i int, j int, score double")


def counts(lists: DataFrame, threshold: float = scores.THRESHOLDS["levenshtein"]) -> DataFrame:
    """(key, tp, fp, fn) of lists (key, e, a) without blank values: what is matched; what else the actual side has; what the expected side has more.

    Lists of many pairs are matched by blocks over rows, all others in their row.
    """
    many = F.size("e").cast("long") * F.size("a") > PAIRS
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in "ea"]
    sized = scored(lists.where(~F.coalesce(many, F.lit(False))).select("key", *sizes, "e", "a"), threshold, rest=False)
    long = lists.where(many)
    if not long.isEmpty():
        hits = assigned(long, threshold).groupBy("key").agg(F.count("*").alias("tp"))
        sized = sized.unionByName(long.select("key", *sizes).join(hits, "key", "left"))
    tp = F.coalesce("tp", F.lit(0).cast("long"))
    return sized.select("key", tp.alias("tp"), (F.col("n_a") - tp).alias("fp"), F.greatest(F.col("n_e") - F.col("n_a"), F.lit(0).cast("long")).alias("fn"))
