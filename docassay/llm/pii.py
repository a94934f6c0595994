"""Personal data by candidate gradient boosting.

Generators with high recall propose spans that may overlap: all that the base patterns match, valid or not, and
looser forms (numbers without a plus, addresses spelt out). Base spans, those that pass the base rules, always
stay. For the others boosted trees over format and context learn which candidates the rules confirm. What only tells
how a candidate was found is no feature: numbers are described without their plus, spelt addresses as the addresses
that they spell, and the rule's own checksum and range aren't seen. A card or IP that fails its rule is wrong; but
phones and addresses in looser forms are unlabelled rather than wrong, as the rules confirm only a part of what is
real: their estimate is divided, by kind, by its mean over confirmed candidates held out from training. A candidate
whose calibrated probability reaches THRESHOLD is redacted too. Of overlapping additions the likelier stays, and none overlaps a base span. The trees learn from at most
CANDIDATES candidates (of least hash of text and place) of the SAMPLE different texts of least hash.

Edge cases: a null text is an empty one, without spans; every pattern and sweep runs in linear time (and sorting),
however long a text or a name in it; repeated rows give repeated results; an empty table gives an empty one, and no
candidates give no additions. `spans` replaces a column of that name, all others pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, _parse_datatype_string

from .common import append, mapped

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the sample: documents, and candidates in them. Then trees, their depth and step; calibrated probability that redacts.
SAMPLE, CANDIDATES = 8000, 50_000
TREES, DEPTH, STEP, THRESHOLD = 40, 3, 0.3, 0.8
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,5}){2,4}(?![0-9])")
SPELT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)+")
CONTEXT = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "call", "tel", "fax", "mobile")}

Span = tuple[int, int, int, bool]  # start, kind, end, whether the base rule holds


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def proposals(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost without overlap in each kind, with whether their rule holds."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end(), True))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in NUMBER.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        found.append((m.start(), 2, m.end(), 12 <= len(digits) <= 19 and luhn(digits)))
    if "." in text:
        for m in DOTTED.finditer(text):
            parts = m.group().split(".")
            start = m.start()
            for i in range(0, len(parts) - 3, 4):
                end = start + sum(map(len, parts[i : i + 4])) + 3
                found.append((start, 1, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4])))
                start = end + 1
    if "+" in text:
        for m in PHONE.finditer(text):
            found.append((m.start(), 3, m.end(), 9 <= sum(map(str.isdigit, m.group())) <= 15))
    return found


def looser(text: str) -> list[Span]:
    """Spans of the looser generators."""
    found = [(m.start(), 3, m.end(), False) for m in LOOSE.finditer(text)]
    if "at]" in text or "at)" in text:
        found += [(m.start(), 0, m.end(), False) for m in SPELT.finditer(text)]
    return found


def described(text: str, span: Span) -> list[float]:
    """Format and context of a span, as if it were written in the usual way."""
    start, kind, end, _ = span
    s = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    near = text[max(0, start - 30) : start].lower()
    if kind == 0:
        s = re.sub(r" ?[\[(]at[\])] ?", "@", re.sub(r" ?[\[(]dot[\])] ?", ".", s))
    elif kind == 3:
        s = s.lstrip("+")
    groups = re.findall("[0-9]+", s)
    digits = sum(map(len, groups))
    return [
        kind, 0 if kind == 3 else len(s), 0 if kind == 3 else digits, 0 if kind == 3 else len(groups), 0 if kind == 3 else max(map(len, groups), default=0), s.count(".") if kind != 3 else 0, s.count("-") if kind == 2 else 0, s.count(" ") if kind == 2 else 0,
        float(before.isalnum() or before in ("_", "-", ".", '"', "'") and before != ""), float(after.isalnum() or after in ("_", '"', "'") and after != ""),
        float(any(w in near for w in CONTEXT[KINDS[kind]])), float("=" in near or ":" in near), float("#" in near or "no." in near or "id" in near.split()), float(kind == 3 and 9 <= digits <= 15),
    ]


class Trees:
    """Boosted regression trees on the logistic loss, grown level by level over at most 16 cuts a feature."""

    def __init__(self) -> None:
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = -3.0
        self.rate = np.ones(len(KINDS))

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            z += leaf[node - (2**DEPTH - 1)]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by kind."""
        return np.minimum(1, 1 / (1 + np.exp(-self.raw(x))) / self.rate[x[:, 0].astype(int)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not 0 < y.sum() < len(y):
            return self
        held = np.arange(len(y)) % 4 == 3
        all_x, all_y, x, y = x, y, x[~held], y[~held]
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])) for f in range(x.shape[1])]
        cuts = [np.unique(np.concatenate([c, np.unique(x[:, f])[:12]])) for f, c in enumerate(cuts)]
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), int)
            feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
            for depth in range(DEPTH):
                for n in range(2**depth - 1, 2 ** (depth + 1) - 1):
                    own = node == n
                    if own.sum() < 20:
                        continue
                    best, gs, hs, xs = 1e-6, g[own], h[own], x[own]
                    whole = gs.sum() ** 2 / (hs.sum() + 1)
                    for f, cs in enumerate(cuts):
                        for c in cs:
                            right = xs[:, f] > c
                            gr, hr = gs[right].sum(), hs[right].sum()
                            gain = gr**2 / (hr + 1) + (gs.sum() - gr) ** 2 / (hs.sum() - hr + 1) - whole
                            if gain > best:
                                best, feature[n], cut[n] = gain, f, c
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            at = node - (2**DEPTH - 1)
            leaf = STEP * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
            self.trees.append((feature, cut, leaf))
            z += leaf[at]
        for k in (0, 3):
            sure = held & (all_y == 1) & (all_x[:, 0] == k)
            if sure.sum() >= 5:
                self.rate[k] = max(1e-3, float((1 / (1 + np.exp(-self.raw(all_x[sure])))).mean()))
        return self


def train(docs: DataFrame) -> Trees:
    """Trees that tell confirmed candidates, from a bounded sample of documents."""
    hashed = docs.select("text", F.xxhash64("text", F.lit("pii")).alias("h")).where("text is not null")
    least = hashed.select("h").distinct().orderBy("h").limit(SAMPLE)
    some = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y, place, of = [], [], [], []
        for h, t in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True):
            text = t.as_py()
            every = [*proposals(text), *looser(text)]
            sure = Taken([s for s in every if s[3]])
            for i, span in enumerate(every):
                if not span[3] and not sure.free(span):
                    continue  # a part of what is confirmed says nothing
                x.append(described(text, span))
                y.append(int(span[3]))
                place.append(i)
                of.append(h)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(place, pa.int64()), pa.array(of, pa.int64())], names=["x", "y", "place", "h"])

    got = mapped(some, "x array<double>, y int, place long, h long", run)
    rows = sorted((r.h, r.place, tuple(r.x), r.y) for r in got.orderBy(F.xxhash64("h", "place"), "x").limit(CANDIDATES).collect())
    if not rows:
        return Trees()
    order = np.random.default_rng(3).permutation(len(rows))
    return Trees().fit(np.array([rows[i][2] for i in order]), np.array([rows[i][3] for i in order]))


class Taken:
    """Places of a text that spans cover, as sorted intervals that don't meet."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[2])  # intervals before k begin before the span ends
        return not k or self.ends[k - 1] <= span[0]

    def add(self, span: Span) -> None:
        k = bisect_left(self.starts, span[2])
        self.starts.insert(k, span[0])
        self.ends.insert(k, span[2])


def spans(text: str, trees: Trees) -> list[tuple[int, int, int, bool]]:
    """Base spans and additions, by start, then kind."""
    if not any(c in text for c in "0123456789@[("):  # no generator proposes anything without one of these
        return []
    base = proposals(text)
    kept = [s for s in base if s[3]]
    others = [s for s in (*base, *looser(text)) if not s[3] and s[2] - s[0] > 5]
    if others and trees.trees:
        p = trees.probability(np.array([described(text, s) for s in others]))
        taken = Taken(kept)
        for at in np.argsort(-p, kind="stable"):
            s = others[at]
            if p[at] < THRESHOLD:
                break
            if taken.free(s):
                kept.append(s)
                taken.add(s)
    return sorted(kept)


def find(docs: DataFrame, trees: Trees) -> DataFrame:
    """Adds `spans`: kind, start and end in code points, and whether the base rule holds."""
    kind = _parse_datatype_string("array<struct<kind:string,start:int,end:int,base:boolean>>")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [[(KINDS[k], a, b, sure) for a, k, b, sure in spans(t.as_py() or "", trees)] for t in batch.column("text")]
        names = ("kind", "start", "end", "base")
        return [pa.array([[dict(zip(names, s, strict=True)) for s in x] for x in made], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))]

    return append(docs, [StructField("spans", kind)], run)
