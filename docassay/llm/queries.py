"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_tree, gif, language_id, log_templates, order_minhash, pii, quality_fm, secrets, source_audit, spelling, unit_dedup, winnowing
from ..sources.tables import spread
from .common import read


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).withColumnRenamed("text", "decoded")  # replaced, so texts don't come back
    tokens = bpe.round_trip(docs, path, public_tokenizers.PATTERN, "decoded")
    return tokens.select("doc_id", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality_fm.train(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return quality_fm.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.drop_repeats(documents(spark, sf_dir))


def digests(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of base spans by kind, the digest of those spans, and all spans, from `spans`."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return digests(pii.find(docs, pii.train(docs)).drop("text"), ["email", "ip", "card", "phone"])


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return unit_dedup.dedup(docs, "line", passages=unit_dedup.PASSAGES)


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumnRenamed("text", "payload")  # replaced, so texts don't come back
    stored = gif.round_trip(docs.withColumn("n_bytes", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")), "payload")
    total = F.aggregate(F.transform("frames", lambda f: f["histogram"]), F.array_repeat(F.lit(0).cast("long"), 65), lambda a, h: F.zip_with(a, h, lambda x, y: x + y))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("frames").cast("string"), F.lit(";"), F.array_join(total.cast("array<string>"), ",")).alias("feature"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    stream, members = chat_tree.format_chats(rows.unionByName(more))
    return chat_tree.read_back(stream, members)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(secrets.find(documents(spark, sf_dir)).drop("text"), ["assign", "access", "hex"])


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(spread(read(spark, sf_dir, "documents").select("text", "lang", "source")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = language_id.identify(docs.drop("lang"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_pii": op2_pii,
        "op3_quality": op3_quality,
        "op4_unit_dedup": op4_unit_dedup,
        "op5_gif": op5_gif,
        "op6_chat": op6_chat,
        "op7_secrets": op7_secrets,
        "op8_near_dedup": op8_near_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_line_dedup": op10_line_dedup,
        "op11_source_audit": op11_source_audit,
        "op12_language_id": op12_language_id,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": winnowing.OP9_SQL, "op10_line_dedup": log_templates.OP10_SQL, "op11_source_audit": source_audit.OP11_SQL}
