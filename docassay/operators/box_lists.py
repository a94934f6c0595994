"""Counts and scores of two lists of values that are boxes, over Arrow batches: those of scoring's columns, without values."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pairs of boxes that are worked out at once; rows of more go by one value after the other.
PAIRS = 1_000_000
#: tp, fp, fn, score.
Counts = tuple[int, int, int, int, float]


class _Side:
    """The boxes of a batch's values: offsets of rows in values, of values in boxes, and the boxes' numbers."""

    def __init__(self, column: pa.ListArray, texts: pa.ListArray) -> None:
        self.values = column.offsets.to_numpy()
        inner = column.values
        self.boxes = inner.offsets.to_numpy()
        numbers = inner.values
        self.of = numbers.values.to_numpy(zero_copy_only=False).reshape(-1, 5)
        self.some = texts.values.to_numpy(zero_copy_only=False)
        self.area = self.of[:, 3] * self.of[:, 4]
        self.value = np.repeat(np.arange(len(self.boxes) - 1), np.diff(self.boxes))
        self.value_area = np.bincount(self.value, self.area, len(self.boxes) - 1)


def _overlaps(e: np.ndarray, a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    e, a = e[i], a[j]
    w = np.minimum(e[:, 1] + e[:, 3], a[:, 1] + a[:, 3]) - np.maximum(e[:, 1], a[:, 1])
    h = np.minimum(e[:, 2] + e[:, 4], a[:, 2] + a[:, 4]) - np.maximum(e[:, 2], a[:, 2])
    return np.where((e[:, 0] == a[:, 0]) & (w > 0) & (h > 0), w * h, 0.0)


def _paired(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of the ranges from starts to ends and from first to last, by range, i and j."""
    sizes = ends - starts
    i = np.repeat(starts - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum())
    n, low = np.repeat(last - first, sizes), np.repeat(first, sizes)
    at = np.repeat(low - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
    return np.repeat(i, n), at


def _similarities(e: _Side, a: _Side, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Shared over larger area of all pairs of the values in these ranges, by range, expected and actual value."""
    x, y = _paired(starts, ends, first, last)
    i, j = _paired(e.boxes[x], e.boxes[x + 1], a.boxes[y], a.boxes[y + 1])
    sizes = np.diff(e.boxes)[x] * np.diff(a.boxes)[y]
    pair = np.repeat(np.arange(len(x)), sizes)
    each = _overlaps(e.of, a.of, i, j)
    if len(each) > len(x):  # several boxes in a value: summed by expected box first
        _, run = np.unique(np.stack([pair, i]), axis=1, return_inverse=True)
        run = run.reshape(-1)
        begins = np.flatnonzero(np.diff(run, prepend=-1))
        each, pair = np.bincount(run, each), pair[begins]
    shared, larger = np.bincount(pair, each, len(x)), np.maximum(e.value_area[x], a.value_area[y])
    return np.divide(shared, larger, out=np.zeros(len(x)), where=larger != 0)


def _greedy(near: Callable[[int], Sequence[float]], e: Sequence[bool], a: Sequence[bool], threshold: float) -> Counts:
    """Counts and mean score of matching.greedy(); near gives the similarities of an expected value, e and a tell whether values are texts."""
    left, tried, without = list(range(len(a))), list(range(len(e))), []
    counts, total = [0, 0, 0, 0], 0.0

    def count(x: bool, y: bool, score: float) -> None:
        counts[(0 if x and score >= threshold else 1) if y else 2 if x else 3] += 1

    for least in (threshold, 0.0):
        over = []
        for i in tried:
            best = None
            if left:
                scores = near(i)
                best = max(left, key=scores.__getitem__)
            if best is None or scores[best] < least:
                over.append(i)
            else:
                left.remove(best)
                total += scores[best]
                count(e[i], a[best], scores[best])
        n = len(left) if least else 0
        tried, without = over[:n], over if not least else over[n:]
        if least:
            later = without
    for i in [*without, *later]:
        count(e[i], False, 0.0)
    for j in left:
        count(False, a[j], 0.0)
    n = len(e) + len(a) - (len(e) - len(without) - len(later))
    return *counts, total / n if n else 1.0


def _matched(e: _Side, a: _Side, threshold: float) -> list[Counts]:
    made: list[Counts] = []
    n, m = np.diff(e.boxes[e.values]), np.diff(a.boxes[a.values])
    pairs = np.maximum(n, np.diff(e.values)).astype(np.int64) * np.maximum(m, np.diff(a.values))
    row = 0
    while row < len(pairs):
        end = row + max(1, int(np.searchsorted(pairs[row:].cumsum(), PAIRS, "right")))
        many = pairs[row] > PAIRS
        if not many:
            every = _similarities(e, a, e.values[row:end], e.values[row + 1 : end + 1], a.values[row:end], a.values[row + 1 : end + 1]).tolist()
            at = 0
        for r in range(row, end):
            (e0, e1), (a0, a1) = e.values[r : r + 2].tolist(), a.values[r : r + 2].tolist()
            size = a1 - a0
            if many:
                near = lambda i, e0=e0, a0=a0, a1=a1: _similarities(e, a, *(np.array([k]) for k in (e0 + i, e0 + i + 1, a0, a1))).tolist()
            else:
                near = lambda i, at=at, size=size: every[at + i * size : at + (i + 1) * size]  # noqa: E731, B023
                at += (e1 - e0) * size
            made.append(_greedy(near, e.some[e0:e1].tolist(), a.some[a0:a1].tolist(), threshold))
        row = end
    return made


def _areas(e: _Side, a: _Side, by: float) -> list[Counts]:
    """tp (shared area), fp, fn, and their F1 as boxes.area_counts() has them."""
    rows = len(e.values) - 1
    scaled = [np.concatenate([s.of[:, :1], np.rint(s.of[:, 1:] * by)], axis=1) for s in (e, a)]
    starts, first = e.boxes[e.values], a.boxes[a.values]
    both = np.zeros(rows)
    pairs = (np.diff(starts).astype(np.int64) * np.diff(first)).cumsum()
    row = 0
    while row < rows:
        end = row + max(1, int(np.searchsorted(pairs[row:] - (pairs[row - 1] if row else 0), PAIRS, "right")))
        step = int(starts[end] - starts[row]) if end > row + 1 else max(1, PAIRS // max(1, int(first[end] - first[row])))
        for k in range(int(starts[row]), int(starts[end]), max(1, step)):
            i, j = _paired(np.maximum(starts[row:end], k), np.minimum(starts[row + 1 : end + 1], k + step), first[row:end], first[row + 1 : end + 1])
            inner = np.bincount(i - k, _overlaps(*scaled, i, j), 1) if len(i) else np.zeros(0)
            of = np.searchsorted(starts, np.arange(k, k + len(inner)), "right") - 1
            both += np.bincount(of, inner, rows)[:rows]
        row = end
    whole = [np.bincount(np.repeat(np.arange(rows), np.diff(o)), s[:, 3] * s[:, 4], rows) for s, o in zip(scaled, (starts, first), strict=True)]
    tp, fp, fn = (np.rint(x) for x in (both, whole[1] - both, whole[0] - both))
    ratio = lambda x, y: np.divide(x, y, out=np.zeros(rows), where=y != 0)
    precision, recall = ratio(tp, tp + fp), np.where(tp + fn > 0, ratio(tp, tp + fn + fp), 0.0)
    return list(zip(*(x.astype(np.int64).tolist() for x in (tp, fp, fn)), [0] * rows, ratio(2 * precision * recall, precision + recall).tolist(), strict=True))


def counted(rows: DataFrame, keys: Sequence[str], custom: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """From rows (keys, and e, a, e_some, a_some behind a prefix: boxes of values, and whether these are texts) a row for each (name, type, prefix, resolution or threshold) of custom."""
    out = rows.select(*keys).schema
    for c in ("field_name", "scoring_type", "scoring_method"):
        out = out.add(c, "string")
    for c in ("tp", "fp", "fn", "tn", "score"):
        out = out.add(c, "double" if c == "score" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, kind, prefix, number in custom:
                e, a = (_Side(b.column(f"{prefix}{c}"), b.column(f"{prefix}{c}_some")) for c in "ea")
                made = _areas(e, a, number) if kind == "bounding_box_intersection_area" else _matched(e, a, number)
                columns = zip(*made, strict=True) if made else [()] * 5
                said = [pa.array([x] * b.num_rows, pa.string()) for x in (name, kind, kind)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), *said, *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True))], names=out.names)

    return rows.mapInArrow(run, out)
