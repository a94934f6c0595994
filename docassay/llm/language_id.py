"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts become small-letter code points, what isn't a letter one space; their 1- to 3-grams are hashed. Document
frequencies cover all rows to learn from; weights are learnt from a bounded sample of them (the TRAINING rows of least
hash, languages taking turns) by follow-the-regularised-leader with elastic-net penalties, and a temperature is fitted
on every fifth row of it, which the weights haven't seen. Scoring runs over all rows.

Edge cases: a null text, and one without letters, is `und` with a score of 0; so is every text if nothing could be
learnt; very long texts are read whole, piece by piece; rows with a null text, lang or doc_id aren't learnt; rows that
repeat doc_id, text and lang are learnt once. `lang_pred` and `score` replace columns of those names, all others pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import append, mapped

#: Bound of the sample; hashed n-grams, as a power of two; longest n-gram; code points that are hashed at once.
TRAINING, BITS, LONGEST, PIECE = 3000, 15, 3, 1 << 20
SIZE = 1 << BITS
#: Step and its smoothing, weight of the sum of absolute values and of squares; passes; one row in CALIBRATION is left for the temperature.
ALPHA, BETA, L1, L2, PASSES, CALIBRATION = 1.0, 1.0, 0.02, 0.01, 3, 5
UNKNOWN = "und"
#: Which of the first code points are letters; later ones all count as such in n-grams.
LETTER = np.array([chr(c).isalpha() for c in range(0x250)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's hashed n-grams, ascending, and how often each occurs."""
    counts = np.zeros(SIZE, np.int64)
    low = f" {text.lower()} "
    for at in range(0, len(low), PIECE):
        cut = low[max(0, at - LONGEST + 1) : at + PIECE]
        c = np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where((c >= len(LETTER)) | LETTER[np.minimum(c, len(LETTER) - 1)], c, 32).astype(np.uint32)
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        h = c
        for n in range(1, LONGEST + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=SIZE)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    """Weights of n-grams that any language uses, by languages in order; without languages, nothing is known."""

    langs: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(SIZE, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE + 1, 0), np.float32))
    temperature: float = 1.0

    def values(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF, of length 1, and a last feature for the bias."""
        x = (1 + np.log(counts)) * self.idf[ids]
        return np.append(ids, SIZE), np.append(x / np.linalg.norm(x), 0.1)

    def chances(self, text: str) -> np.ndarray:
        ids, x = self.values(*grams(text))
        return softmax(x @ self.weights[ids] / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = self.chances(text)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """FTRL-proximal: each row's gradient moves z and n; weights follow from them, 0 where |z| is within L1."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for k in rng.permutation(len(rows)):
            ids, x, y = rows[k]
            zk, nk = z[ids], n[ids]
            w = weights(zk, nk)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(nk + g * g)
            z[ids] = zk + g - (root - np.sqrt(nk)) / ALPHA * w
            n[ids] = root * root
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """That of least log loss, from 1/20 to 20, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda u: -np.log(np.maximum(softmax(logits / np.exp(u))[np.arange(len(y)), y], 1e-300)).mean()
    low, high, part = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text, modulo 4, is 2; a null id isn't held out, nor learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def frequencies(texts: DataFrame) -> np.ndarray:
    """Documents that have each n-gram; the last number is that of all documents. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for b in batches:
            for t in b.column("text"):
                total[grams(t.as_py())[0]] += 1
                total[SIZE] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for r in texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # SIZE + 1 rows at most
        out[r.gram] = r.n
    return out


def train(docs: DataFrame) -> Model:
    """From doc_id, text and lang of docs that aren't held out."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = known.select("lang", "h").distinct().withColumn("turn", turn).where(F.col("turn") <= TRAINING).orderBy("turn", "lang").limit(TRAINING).select("lang", "h")
    texts = known.join(F.broadcast(some), ["lang", "h"]).groupBy("lang", "h").agg(F.any_value("text").alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [grams(t.as_py()) for t in b.column("text")]
        return pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), *(pa.array([m[k].astype(np.int32) for m in made], pa.list_(pa.int32())) for k in (0, 1))], names=["lang", "h", "ids", "counts"])

    got = mapped(texts, "lang string, h long, ids array<int>, counts array<int>", run).toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    if not len(got):
        return Model()
    df = frequencies(known)
    model = Model(sorted(set(got["lang"].to_pylist())), (np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1).astype(np.float32))
    place = {lang: k for k, lang in enumerate(model.langs)}
    rows = [(*model.values(np.asarray(i.values), np.asarray(c.values)), place[lang.as_py()]) for i, c, lang in zip(got["ids"], got["counts"], got["lang"], strict=True)]
    seen = [r for k, r in enumerate(rows) if k % CALIBRATION or len(rows) < 10 * len(model.langs)]
    model.weights = fit(seen, len(model.langs)).astype(np.float32)
    rest = rows[::CALIBRATION] if len(seen) < len(rows) else []
    model.temperature = temperature(np.array([x @ model.weights[ids] for ids, x, _ in rest]), np.array([y for *_, y in rest], int))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `lang_pred` and `score`, its calibrated chance."""

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        made = [model.predict(t.as_py()) for t in b.column("text")]
        return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]

    return append(docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], run)
