"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

The score is sigmoid(b + sum w_i x_i + half of sum over factors of ((sum v_i x_i)^2 - sum v_i^2 x_i^2)): all
pairwise interactions in time linear in the features. Training takes a bounded sample of the labelled rows (the
TRAINING rows of least hash), is done by numpy with AdaGrad, and its seed is fixed; scoring runs over all rows.

Edge cases: a null text is an empty one; an empty text has the statistics of none and gets a score; very long
texts are scored whole; labels that are null are not learnt; ids that repeat among the labels are learnt as often;
without labelled rows every score is 0.5. `score` and `predicted` replace columns of those names, all others pass.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .common import append, mapped

#: Bound of the sample to learn from; buckets of hashed words; factors; passes; step.
TRAINING, WORDS, FACTORS, PASSES, STEP = 6000, 1 << 14, 6, 6, 0.05
#: Bins of each statistic, and how many statistics there are.
BINS, STATISTICS = 12, 10
SIZE = WORDS + BINS * STATISTICS
SYMBOLS, DIGITS, UPPER, BARS = re.compile(r"[#$%&*!?@^~<>|=+\\/{}\[\]_]"), re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"\s\|\s")


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure and metadata of a text, each from 0 to 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.count("\n") + 1
    top = max(counts.values(), default=0)
    return [
        min(1.0, np.log2(1 + len(words)) / 16),
        min(1.0, np.log2(1 + len(text) / n) / 6),
        len(counts) / n,
        top / n,
        min(1.0, len(SYMBOLS.findall(text)) / n),
        min(1.0, len(DIGITS.findall(text)) / chars * 4),
        min(1.0, len(UPPER.findall(text)) / chars * 2),
        min(1.0, len(BARS.findall(text)) / n),
        min(1.0, lines / n * 4),
        min(1.0, (text.count(".") + text.count(",")) / n),
    ]


def features(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, each once, and values of the features of a text; words of one number count together."""
    words = text.split()
    counts = Counter(words)
    try:
        ids = [known[w] for w in counts]
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        ids = [known.setdefault(w, zlib.crc32(w.lower().encode()) % WORDS) for w in counts]
    stats = [WORDS + k * BINS + min(BINS - 1, int(v * BINS)) for k, v in enumerate(statistics(text, words, counts))]
    times = np.fromiter(counts.values(), float, len(ids))
    once, place = np.unique(np.array(ids, np.int32), return_inverse=True)
    if len(once) < len(ids):
        times = np.bincount(place, times)
    else:
        once = np.array(ids, np.int32)
    values = np.full(len(once) + len(stats), 0.5)
    if len(once):
        values[: len(once)] = np.log1p(times)
        values[: len(once)] /= np.linalg.norm(values[: len(once)])
    return np.concatenate([once, np.array(stats, np.int32)]), values


@dataclass
class Machine:
    """The weights; bias only, for an even chance, until fitted."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, ids: np.ndarray, values: np.ndarray) -> float:
        s = values @ self.v[ids]
        return float(self.bias + values @ self.w[ids] + 0.5 * (s @ s - (values**2) @ (self.v[ids] ** 2).sum(1)))

    def score(self, text: str, known: dict[str, int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*features(text, known)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """AdaGrad on the logistic loss; classes count alike, so a score of a half parts them."""
    rng = np.random.default_rng(11)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, FACTORS)))
    ones = sum(y for *_, y in rows)
    if not 0 < ones < len(rows):
        return m if not rows else Machine(4.0 if ones else -4.0, m.w, m.v)
    weight = (len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones))
    gw, gv, gb = np.full(SIZE, 1e-3), np.full((SIZE, FACTORS), 1e-3), 1e-3
    for _ in range(PASSES):
        for k in rng.permutation(len(rows)):
            ids, x, y = rows[k]
            v = m.v[ids]
            s = x @ v
            z = m.bias + x @ m.w[ids] + 0.5 * (s @ s - (x**2) @ (v**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[y]
            gb += g * g
            m.bias -= STEP * g / np.sqrt(gb)
            d = g * x
            gw[ids] += d * d
            m.w[ids] -= STEP * d / np.sqrt(gw[ids])
            d = g * (x[:, None] * s - v * (x**2)[:, None]) + 1e-5 * v
            gv[ids] += d * d
            m.v[ids] -= STEP * d / np.sqrt(gv[ids])
    return m


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """From labels (doc_id, quality) of rows that aren't held out: crc32 of doc_id as text, modulo 3, is not 1."""
    ident = F.col("doc_id").cast("string")
    known_rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(ident) % 3 != 1))
    some = known_rows.select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64(ident, F.lit("fm")), "doc_id", "y").limit(TRAINING)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")
    words: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(x.as_py() or "", words) for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))], names=["doc_id", "y", "ids", "x"])

    got = mapped(texts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, ids array<int>, x array<float>", run).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    rows = [(np.array(i.values), np.array(x.values, float), y.as_py()) for i, x, y in zip(got["ids"], got["x"], got["y"], strict=True)]
    return fit(rows)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Adds `score` and `predicted` (1 if the score is at least a half)."""
    words: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s = np.array([machine.score(x.as_py() or "", words) for x in batch.column("text")])
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    return append(docs, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], run)
