"""Source audit, language identification and spelling variants beside SQL, held-out accuracy and brute force."""

import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docassay.llm import common, language_id, queries, source_audit, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
ROWS = [
    (1, "A b c c", "en", "x"), (2, "a B d", "en", "x"), (3, "a b", "en", "y"), (4, None, "en", "z"), (5, "a b c c", "en", "y"), (5, "a b c c", "en", "y"),
    (6, "é É c", "fr", "x"), (7, None, None, None), (8, "a a", "fr", None), (9, "c c 9 c", "en", "y"), (None, "ß|a", "de", "w"), (10, "b " * 60_000 + "a", "en", "w"),
]


def audited(df):
    return sorted(map(tuple, source_audit.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize(("rows", "pairs"), [(common.BROADCAST_ROWS, source_audit.PAIRS), (0, 2)])
def test_audit_is_its_sql(spark, monkeypatch, rows, pairs):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(source_audit, "PAIRS", pairs)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text", "lang", "source"]))
    extra = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("mine") for c in ("term", "n", "digest", "sid", "value", "rank", "g", "zero", "salt")})
    assert audited(extra) == sorted(con.execute(source_audit.OP11_SQL).fetchall())


def test_audit_of_hot_groups_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "COUNTED", 50)
    monkeypatch.setattr(source_audit, "LOOK", 10)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 20))), "en", rng.choice("xxxxyz")) for i in range(120)]
    rows += [(i, "same copies everywhere", "en", "x") for i in range(120, 320)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    assert audited(spark.createDataFrame(rows, SCHEMA)) == sorted(con.execute(source_audit.OP11_SQL).fetchall())
    assert audited(spark.createDataFrame([], SCHEMA)) == []


def test_shares_are_exact_beyond_longs(spark):
    big = 9_000_000_000_123
    row = spark.sql(f"SELECT {big}L AS n, {3 * big}L AS w").select(source_audit.share(F.col("n"), F.col("w")).alias("p"), source_audit.share(0, F.col("w")).alias("z"), source_audit.share(F.col("n"), F.lit(0)).alias("none")).first()
    assert tuple(row) == (1 + 10**9 * (big + 1) // (3 * big), 1 + 10**9 // (3 * big), None)


def test_languages_held_out(spark):
    got = {r.doc_id: r for r in queries.queries()["op12_language_id"](spark, SF).collect()}
    want = dict(duckdb.sql(f"select doc_id, lang from read_parquet('{SF}/documents.parquet')").fetchall())
    assert got.keys() == want.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == want[i] for i in held]) > 0.97


def test_language_edges(spark):
    texts = [("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("le chat et la souris", "fr")]
    rows = [(i, f"{t} {i % 7}", lang, "s") for i, (t, lang) in enumerate(texts * 20)] + [(None, "ghost", "xx", "s"), (98, "none", None, "s"), (99, None, "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs)
    assert model.langs == ["de", "en", "fr"]
    asked = [(1, None), (2, ""), (3, "12 34 — !"), (4, "the cat " * 400_000), (5, "die Katze"), (5, "die Katze")]
    out = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string").withColumns({"score": F.lit("old"), "lang_pred": F.lit("old")}), model).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "de", "de"]
    assert [r.score for r in out[:3]] == [0.0] * 3
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.train(empty).predict("the cat") == ("und", 0.0)
    assert language_id.identify(empty, model).count() == 0


def test_language_training_takes_turns_and_is_sparse(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAINING", 12)
    rows = [(i, f"text number {'abc'[i % 3]} {i}", "en" if i % 10 else "de", "s") for i in range(300)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["de", "en"] and (model.weights != 0).mean() < 0.05


def test_pieces_count_the_same_ngrams(monkeypatch):
    text = "Ein langer  Text, mit 12 Zahlen; und é. " * 30
    whole = language_id.grams(text)
    monkeypatch.setattr(language_id, "PIECE", 64)
    near = language_id.grams(text)
    both = set(whole[0]) & set(near[0])
    assert len(both) >= 0.98 * len(whole[0])


def one_edit(words):
    """By brute force: n_near, and n and text of the best near word."""
    letters, out = set("".join(words)), {}
    for w in words:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))}
        near |= {w[:i] + a + w[i + k :] for i in range(len(w) + 1) for a in letters for k in (0, 1)}
        near = [(-words[x], x) for x in near - {w} if x in words]
        out[w] = (len(near), *((min(near)[1], -min(near)[0]) if near else (None, None)))
    return out


def grouped(rows):
    """All columns of the contract, from plain Python."""
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += len(run) >= 7
                run = ""
    words = {w: n for w, n in counts.items() if n >= 2}
    near = one_edit(words)
    form = {w: f if f and n >= 10 * words[w] else None for w, (_, f, n) in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, near[w][0], words[form[w]] if form[w] else None) for w, n in words.items())


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_spelling_of_the_smallest_table(spark):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    got = rows_of(queries.queries()["op13_spelling"](spark, SF))
    assert got == grouped(rows) and any(r[1] for r in got)


@pytest.mark.parametrize(("size", "rows"), [(spelling.LIST, spelling.ROWS), (40, 100)])
def test_near_words_by_brute_force(spark, monkeypatch, size, rows):
    monkeypatch.setattr(spelling, "LIST", size)
    monkeypatch.setattr(spelling, "ROWS", rows)
    rng = random.Random(size)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.randint(7, 10))): rng.randint(2, 9) for _ in range(3000)}
    words |= {"q" * n: n for n in range(7, 40)} | {"a" * 300: 5, "a" * 299: 5, "a" * 150 + "b" + "a" * 149: 7}
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.neighbours(common.stored(spark.createDataFrame(list(words.items()), "word string, n long"))).collect()}
    assert got == {w: x for w, x in one_edit(words).items() if x[0]}


def test_spelling_edges(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    chain = " ".join(["abcdefgh"] * 2 + ["abcdefghi"] * 20 + ["abcdefghij"] * 200 + ["abcdefghijk"] * 2000)
    rows = [(1, None), (2, ""), (3, chain), (None, "Wordings wordings WORDINGS ÉtésÉtés ő short"), (4, "wordings"), (4, "wordings wordingûs 中文wordingses 中"), (5, "Langwortes " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("mine"), "n": F.lit(1), "list": F.lit("x"), "root": F.lit("x")})
    began = time.time()
    got = rows_of(spelling.group(df))
    assert got == grouped(rows) and time.time() - began < 60
    assert {r[0]: r[2] for r in got}["abcdefgh"] == "abcdefghijk"
    assert rows_of(spelling.group(spark.createDataFrame([], "doc_id long, text string"))) == []
