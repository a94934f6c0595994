"""Stages from documents to tokens, each with one operator of docassay.llm, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm import bpe, log_templates, order_minhash, quality_fm, winnowing
from docassay.llm.common import discard, read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled rows of the table that it filters."""
    machine = quality_fm.train(docs, read(spark, sf_dir, "labels"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))  # the text goes to Python and back once
    scored = quality_fm.score(docs.select("text", rest.alias("row")), machine)
    return scored.where("predicted = 1").select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; n_chars follows the text."""
    rest = log_templates.drop_repeats(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    return rest.select(*(F.col("text") if c == "text" else F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return order_minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that are contaminated by the benchmark."""
    return winnowing.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = docs.select("doc_id", F.col("text").alias("decoded"))  # replaced, so texts don't come back
    tokens = bpe.round_trip(texts, path, public_tokenizers.PATTERN, "decoded")
    return tokens.select("doc_id", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), "tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: A classifier's scores, edit-distance classes and BPE merges can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each through a Parquet table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        made = stored(stage(spark, docs, sf_dir))
        discard(docs)  # a stage's table that the next one has read
        docs = made
    return docs
