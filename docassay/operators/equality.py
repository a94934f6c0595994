"""Counts and scores of fields by methods that only ask whether values are equal, over Arrow batches: those of scoring's columns, without values."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Plain = Callable[[str], str]
#: tp, fp, fn, tn, score.
Counts = tuple[int, int, int, int, float]
#: Rows that are Python values at once.
ROWS = 256


def _item(e: bool, a: bool, score: float) -> Counts:
    """Of one value, by whether either side has any."""
    tp = e and a and score >= 1
    return int(tp), int(a and not tp), int(e and not a), int(not e and not a), score


def _partial(pairs: Iterable[tuple[str, str, bool]]) -> Counts:
    tp = fp = fn = tn = same = n = 0
    for x, y, equal in pairs:
        n += 1
        same += equal
        if x and y and equal:
            tp += 1
        elif y:
            fp += 1
        elif x:
            fn += 1
        else:
            tn += 1
    return tp, fp, fn, tn, same / n if n else 1.0


def _some(xs: list[str]) -> bool:
    """Whether the values joined with commas are a text."""
    return len(xs) > 1 or bool(xs and xs[0])


def _string(e: list[str], a: list[str], plain: Plain) -> Counts:
    # blanks are single ones within the values already
    x, y = (plain(re.sub("  +", " ", "".join(xs))) for xs in (e, a))
    return _item(x != "", y != "", float(x == y))


def _list(e: list[str], a: list[str], plain: Plain) -> Counts:
    return _item(_some(e), _some(a), float(e == a))


def _partial_list(e: list[str], a: list[str], plain: Plain) -> Counts:
    return _partial((x, y, x == y) for x, y in zip_longest(e, a, fillvalue=""))


def _pairs(e: list[str], a: list[str], plain: Plain) -> list[tuple[str, str, bool]]:
    """The pairs of matching.greedy_equal()."""
    places = defaultdict(deque)
    for j, y in enumerate(a):
        places[plain(y)].append(j)
    found, left = [], []
    for x in e:
        of = places.get(plain(x))
        if of:
            found.append((x, a[of.popleft()], True))
        else:
            left.append(x)
    over = [a[j] for j in sorted(j for of in places.values() for j in of)]
    return found + [(x, y, False) for x, y in zip_longest(left, over, fillvalue="")]


def _partial_ulist(e: list[str], a: list[str], plain: Plain) -> Counts:
    return _partial(_pairs(e, a, plain))


def _ulist(e: list[str], a: list[str], plain: Plain) -> Counts:
    return _item(_some(e), _some(a), _partial_ulist(e, a, plain)[4] if len(e) == len(a) else 0.0)


def _of_sets(of: Callable[[list[str], list[str], Plain], Counts]) -> Callable[[list[str], list[str], Plain], Counts]:
    return lambda e, a, plain: of(sorted(set(e)), sorted(set(a)), plain)


TYPES = {"string": _string, "str": _string, "list": _list, "partial_list": _partial_list, "ulist": _ulist, "partial_ulist": _partial_ulist, "set": _of_sets(_ulist), "partial_set": _of_sets(_partial_ulist)}


def counted(fields: DataFrame, every: Sequence[str], methods: Mapping[str, Plain]) -> DataFrame:
    """From fields (wanted, e, a, and other columns), normalised lists of values without nulls, a row for each of the types that are wanted and each method."""
    keep = [c for c in fields.columns if c not in ("wanted", "e", "a")]
    out = StructType([fields.schema[c] for c in keep])
    names = ("tp", "fp", "fn", "tn", "score")
    for c in ("scoring_type", "scoring_method"):
        out = out.add(c, "string")
    for c in names:
        out = out.add(c, "double" if c == "score" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                made = []
                for k, (wanted, e, a) in enumerate(zip(*(part.column(c).to_pylist() for c in ("wanted", "e", "a")), strict=True)):
                    made += [(k, t, m, *TYPES[t](e, a, plain)) for t in every if t in wanted for m, plain in methods.items()]
                columns = list(zip(*made, strict=True)) if made else [()] * 8
                rows = pa.array(columns[0], pa.int64())
                said = [pa.array(c, pa.string()) for c in columns[1:3]]
                counts = [pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, columns[3:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in keep), *said, *counts], names=out.names)

    return fields.select(*keep, "wanted", "e", "a").mapInArrow(run, out)
