"""Each registered query against its SQL on the smallest tables, and small expected results."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docassay.functions import scores, text
from docassay.operators import boxes, lists, summary
from docassay.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = tidy(registry.queries()[name](spark, SF).toPandas()), tidy(duck.sql(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_small_results(spark):
    lit = F.lit
    assert one(spark, scores.levenshtein(lit("axb"), lit("ayb"))) == pytest.approx(2 / 3)
    assert one(spark, scores.soft(lit("a b"), lit("ab"))) == 1 and one(spark, scores.exact(lit("a b"), lit("ab"))) == 0
    assert one(spark, scores.length_bound(lit("abc"), lit("123456"))) == 0.5
    names = {"J. R. K. Holm": "JRK Holm", "J.Holm": "J Holm", "J Inner Holm": "J Inner Holm", "HOLM J": "HOLMJ", "J.\u00a0R. Holm": "JR Holm", " Å. Ö. X ": "ÅÖX", "": ""}
    assert {k: one(spark, text.person_name(lit(k))) for k in names} == names
    assert one(spark, text.last_page(lit("123"), lit("45"))) == "145"
    assert one(spark, text.doi_from_url(lit("http://dx.doi.org/10.1/x"))) == "10.1/x"
    assert one(spark, text.doi_from_url(lit("http://x.org/10.1/x"))) is None
    assert one(spark, text.normalize_list(F.array(F.array(lit("A \n b"))), lower=True, nested=True)) == [["a b"]]
    assert [tuple(r) for r in one(spark, text.split_with_index(lit("\na\n\nbé\nc"), "\n"))] == [(1, "a"), (4, "bé"), (7, "c")]
    a, b = boxes.parse(lit("1,110,120,50,60")), boxes.parse(lit("1,120,110,100,100"))
    assert one(spark, boxes.shared(a, b)) == 40 * 60 - 0 and one(spark, boxes.area(a)) == 3000
    got = one(spark, lists.partial_list_counts(F.array(lit("a"), lit("b")), F.array(lit("a"))))
    assert (got.tp, got.fn, got.fp, got.score) == (1, 1, 0, 0.5)
    both = spark.createDataFrame([("k", "expected", x) for x in ("a", "b1", "c1")] + [("k", "actual", x) for x in ("a", "c2")], "key string, side string, item string")
    row = lists.unordered_counts(both).first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 1)


def test_metrics(spark):
    df = spark.createDataFrame([("exact", "title", 6, 4, 0)], "scoring_method string, field_name string, tp long, fp long, fn long")
    row = summary.summary(df).where("stats_name = 'by-field'").first()
    assert (row.precision, row.recall, row.tn) == (0.6, 0.6, 4) and row.f1 == pytest.approx(0.6)


@pytest.mark.parametrize("name", ["score_ulist_exact", "score_set_exact"])
def test_documents_without_lines(spark, tmp_path, name):
    got, want = odd_texts(spark, tmp_path, name)
    assert got.score.isna().sum() == 15
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_bound_of_texts_without_characters(spark, tmp_path):
    got, want = odd_texts(spark, tmp_path, "char_count_bound")
    assert len(got) == 20
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def odd_texts(spark, tmp_path, name: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A query and its SQL over texts that are missing, empty or blank, each by all five ways."""
    texts = [None, "", "\n\n", " ", "A\nb\nA\n", "a"]
    rows = [(5 * i + way, t, "en", "web") for i, t in enumerate(texts) for way in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return tidy(registry.queries()[name](spark, str(tmp_path)).toPandas()), tidy(duck.sql(registry.oracle_sql()[name]).df())
