"""Edit distances of long texts, bit by bit over Arrow batches, and of lists of tokens, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Texts up to this length are left to Spark's own function.
SHORT = 64
#: Private code points that stand for tokens: how many different ones a pair can have, and the first.
TOKENS, FIRST = 65_000, 0xF0000


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    return low


def distance(a: str, b: str) -> int:
    """The edit distance: one column of the matrix after the other, each as two whole numbers that hold where it goes up and down.

    Common ends are taken off first. A step works on as many bits as the longer text has left, so time grows with the
    product of both lengths over the bits of a machine's word.
    """
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    every = (1 << len(a)) - 1
    where = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    up, down = every, 0
    for c in b:
        same = where[c]
        x = same | down
        d = (((x & up) + up) ^ up) | x
        right_up = down | (every ^ ((d | up) & every))
        right_down = up & d
        y = (right_up << 1) | 1
        down = y & d & every
        up = ((right_down << 1) | (every ^ ((y | d) & every))) & every
    return len(b) + up.bit_count() - down.bit_count()


@F.pandas_udf(IntegerType())
def _distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for one, other in batches:
        yield pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(one, other, strict=True)], dtype="Int32")


def text_distance(a: Column, b: Column) -> Column:
    """The edit distance of texts of any length. Only pairs that aren't short, equal, or one an end of the other go to Python; not for use in a lambda."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    ends = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
    long = (longest > SHORT) & ~ends
    hard = _distances(F.when(long, a), F.when(long, b))
    return F.when(ends, F.abs(F.char_length(a) - F.char_length(b))).when(longest <= SHORT, F.levenshtein(a, b)).otherwise(hard)


def text_similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - text_distance(a, b) / longest)


def _let(x: Column, use) -> Column:
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _numbers(xs: Column) -> Column:
    """A number for each value of a list, the same for equal ones: their rank, from one sort."""

    def ranked(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i - 1)["v"] != F.get(s, i)["v"]))
        runs = _let(starts, lambda b: F.flatten(F.transform(F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s))), lambda x, y: y - x), lambda n, r: F.array_repeat(r, n))))
        placed = F.sort_array(F.zip_with(s, runs, lambda x, r: F.struct(x["i"].alias("i"), r.alias("r"))))
        return F.transform(placed, lambda x: x["r"])

    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(_let(F.sort_array(F.transform(xs, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), ranked))


def token_distance(a: Column, b: Column) -> Column:
    """The edit distance of two lists of tokens, each token one step: tokens become private code points, lists texts of them.

    A pair with more than TOKENS different tokens ends the job, as there are no more such code points.
    """

    def spelt(numbers: Column) -> Column:
        code = lambda r: F.lpad(F.hex((r + FIRST).cast("long")), 8, "0")
        fits = F.when(F.coalesce(F.array_max(numbers), F.lit(0)) < TOKENS, numbers).otherwise(F.raise_error(F.lit(f"lists of more than {TOKENS} different tokens")))
        return F.decode(F.unhex(F.array_join(F.transform(fits, code), "")), "UTF-32")

    def of(v: Column) -> Column:
        n = F.size(v["a"])
        one, other = F.slice(v["r"], F.lit(1), n), F.slice(v["r"], n + 1, F.size(v["r"]))
        return F.levenshtein(spelt(one), spelt(other))

    return _let(_let(F.struct(a.alias("a"), b.alias("b")), lambda v: F.struct(v["a"].alias("a"), _numbers(F.concat(v["a"], v["b"])).alias("r"))), of)


def token_similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer list; 1 for two empty lists."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(1 - token_distance(a, b) / longest)
