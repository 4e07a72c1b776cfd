"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import ann, audit, bpe, chat, decontam, licenses, passages, pii, repair, repeats, shards, simhash, toxicity
from glyphmill.llm._io import table


def bpe_path() -> str:
    """The vocabulary file of op3; the same path on the driver and each executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(table(spark, sf_dir, "documents"), 40)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), bpe_path())


#: The key of op4's pseudonyms; a user passes their own secret one.
PSEUDONYM_KEY = b"glyphmill demonstration key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, counts=True)


def op5_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0", 10)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return held.select("doc_id", (F.size("leaks") > 0).alias("leaked"), F.col("leaks.item_id").alias("item_ids"), "leaks")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 400)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.fuzzy_passages(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_projections": op5_projections,
    "op6_simhash": op6_simhash,
    "op7_latent": op7_latent,
    "op8_suffix_array": op8_suffix_array,
    "op9_chat": op9_chat,
    "op10_chaining": op10_chaining,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_chat_repair": op13_chat_repair,
}
ORACLES: dict[str, str] = {
    "op9_chat": chat.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op12_license_scan": licenses.ORACLE,
    "op13_chat_repair": repair.ORACLE,
}
