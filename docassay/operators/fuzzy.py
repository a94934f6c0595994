"""Unordered matching of two lists by edit similarity, as matching.greedy() has it, over Arrow batches.

A value that has an equal one left takes it unmeasured. Others go through what is left by falling character bounds, up to
the bound that the best score found is above, so that few pairs are measured; of these most distances are their
least possible one, which a look at both texts proves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import edits, scores

#: Rows that are Python values at once.
ROWS = 256


class _Left:
    """The actual values that are left, and the characters of both sides: how often each value has each."""

    def __init__(self, expected: list[str], actual: list[str]) -> None:
        self.e, self.a = expected, actual
        self.sizes = np.array([len(v) for v in (*expected, *actual)])
        codes = np.frombuffer("".join((*expected, *actual)).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.split(codes, self.sizes.cumsum()[:-1])
        known, which = np.unique(codes, return_inverse=True)
        rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.counts = np.bincount(rows * len(known) + which, minlength=len(self.sizes) * len(known)).reshape(len(self.sizes), len(known))

    def distance(self, i: int, j: int, least: int) -> int:
        """The edit distance of the values i and j, of which the bounds say that it is at least `least`."""
        x, y = self.e[i], self.a[j]
        if len(x) < len(y):
            x, y = y, x
        gap = len(x) - len(y)
        if x.startswith(y) or x.endswith(y):
            return gap
        if gap == 0 and np.count_nonzero(self.codes[i] != self.codes[len(self.e) + j]) == least:
            return least
        if gap == least:
            rest = iter(x)
            if all(c in rest for c in y):  # y is x without some characters
                return gap
        return edits.distance(x, y)

    def best(self, i: int, left: np.ndarray, threshold: float) -> tuple[int, float] | None:
        """The place and score of the best of the values left for expected value i; of equal scores larger bounds win, then the earlier value."""
        n, at = len(self.e), np.flatnonzero(left)
        longest = np.maximum(self.sizes[i], self.sizes[n + at])
        near = np.minimum(self.sizes[i], self.sizes[n + at]) >= threshold * longest - 1e-9
        at, longest = at[near], longest[near]
        lengths = np.minimum(self.sizes[i], self.sizes[n + at]) / longest
        shared = np.minimum(self.counts[i], self.counts[n + at]).sum(1)
        bounds = shared / longest
        found = None
        for k in np.lexsort((at, -lengths, -bounds)):
            if bounds[k] < threshold or found is not None and bounds[k] < found[0]:
                break
            if lengths[k] >= threshold:
                score = 1 - self.distance(i, int(at[k]), int(longest[k] - shared[k])) / int(longest[k])
                key = (score, bounds[k], lengths[k], -int(at[k]))
                if score >= threshold and (found is None or key > found):
                    found = key
        return None if found is None else (-found[3], found[0])


def paired(expected: list[str], actual: list[str], threshold: float, rest: bool = True) -> tuple[list[float], list[float]]:
    """The scores of the pairs that reach the threshold, and those of the pairs of what went without, if `rest` of them are wanted."""
    left, equal = np.ones(len(actual), dtype=bool), defaultdict(list)
    for j in range(len(actual) - 1, -1, -1):
        equal[actual[j]].append(j)
    more, sides = len(actual), None
    passes: tuple[list[float], list[float]] = ([], [])
    without = list(range(len(expected)))
    for made, least in zip(passes, (threshold, 0.0), strict=True):
        tried, over = without[: len(without) if least else more], []
        for i in tried:
            places = equal.get(expected[i], [])
            while places and not left[places[-1]]:
                places.pop()
            found = (places.pop(), 1.0) if places else None
            if found is None and more:
                sides = sides or _Left(expected, actual)
                found = sides.best(i, left, least)
            if found is None:
                over.append(i)
            else:
                left[found[0]] = False
                more -= 1
                made.append(found[1])
        without = over
        if not rest:
            break
    return passes


def scored(lists: DataFrame, threshold: float = scores.THRESHOLDS["levenshtein"], rest: bool = True) -> DataFrame:
    """Adds tp, fp, fn, tn and the mean score, as partial_counts() of greedy(), to lists (e, a, and other columns) without blank values; nulls where a list is null.

    Without `rest` only tp is added.
    """
    names = ["tp", "fp", "fn", "tn", "score"] if rest else ["tp"]
    keep = [c for c in lists.columns if c not in ("e", "a")]
    out = lists.select(*keep).schema
    for c in names:
        out = out.add(c, "double" if c == "score" else "long")

    def row(e: list[str] | None, a: list[str] | None) -> tuple:
        if e is None or a is None:
            return (None,) * len(names)
        sure, others = paired(e, a, threshold, rest)
        n = len(e) + len(a) - len(sure) - len(others)
        return (len(sure), len(a) - len(sure), max(len(e) - len(a), 0), 0, sum((*sure, *others), 0.0) / n if n else 1.0)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                made += map(row, part.column("e").to_pylist(), part.column("a").to_pylist())
            kinds = [pa.float64() if c == "score" else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([m[k] for m in made], t) for k, t in enumerate(kinds))], names=[*keep, *names])

    return lists.select(*keep, "e", "a").mapInArrow(run, out)
