"""Edit distances of texts and of tokens beside the plain matrix."""

import random
import time

from pyspark.sql import functions as F

from docassay.functions import edits


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, text, rate, letters):
    return "".join(c if rng.random() > rate else rng.choice([c + rng.choice(letters), "", rng.choice(letters)]) for c in text)


def test_distance_of_random_texts():
    rng = random.Random(2)
    for letters in ("ab", "abcdé\U0001f600", "日本語abc"):
        for n in (0, 1, 3, 30, 63, 64, 65, 200):
            for rate in (0.05, 0.5, 1.0):
                a = "".join(rng.choice(letters) for _ in range(n))
                b = changed(rng, a, rate, letters)
                assert edits.distance(a, b) == edits.distance(b, a) == plain(a, b), (a, b)


def test_distances_in_columns(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc d") for _ in range(n)) for n in (0, 5, 64, 65, 90, 300)]
    pairs = [(a, b) for a in texts for b in (a, "", a[: len(a) // 2], a[3:], changed(rng, a, 0.1, "xé"), rng.choice(texts))] + [(None, "a"), ("a" * 100, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", edits.text_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [None if None in p else plain(*p) for p in pairs]


def test_long_texts_take_little():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    b = a.replace("a", "x")
    began = time.time()
    assert edits.distance(a, b) == a.count("a") and time.time() - began < 5


def test_tokens(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "B", "word", "é", "", "日本"])
    rows = [([word() for _ in range(rng.randint(0, 8))], [word() for _ in range(rng.randint(0, 8))]) for _ in range(200)]
    rows += [([], []), ([f"t{i}" for i in range(3000)], [f"t{i}" for i in range(1, 3001)])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = df.select("i", edits.token_distance(F.col("a"), F.col("b")).alias("d"), edits.token_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [r.d for r in got[:-1]] == [plain(*r) for r in rows[:-1]] and got[-1].d == 2 and got[-2].s == 1.0
