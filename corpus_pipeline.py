"""The corpus pipeline: five stages over documents, each written and read again by the next."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import _io, bpe, decontam, pii, queries, simhash, toxicity


#: The setting with the secret key of the pseudonyms, at least 16 bytes of UTF-8.
KEY_SETTING = "spark.glyphmill.pseudonym.key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model, learned from the labelled ones among them, scores at 0.5 or more.

    Null and empty texts are scored as texts of no words, very long ones whole; repeated rows are
    scored alike, rows without an id too; an empty table stays empty, and without labels of both kinds the more
    frequent one decides for all. All columns come back, whatever their names.
    """
    model = toxicity.fit(docs, _io.table(spark, sf_dir, "labels"))
    score = _io.unused(docs, "toxicity_score")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < 0.5).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each class of texts whose five-word shingles are 0.8 alike or more.

    Texts without words (null and empty ones) are one class. Rows without an id stay, repeated rows
    of the id that stays all stay; an empty table stays empty; all columns come back.
    """
    return simhash.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold an item of the benchmark.

    Null and empty texts hold none; very long texts are searched whole; repeated rows go or stay
    together; an empty table or benchmark drops nothing. All columns come back, whatever their names.
    """
    leaks = _io.unused(docs, "benchmark_leaks")
    held = decontam.contamination(docs, _io.table(spark, sf_dir, "benchmark"), out_col=leaks)
    return held.where(F.size(leaks) == 0).select(*_columns(docs))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; where it is unset, a new random one for this run that nobody keeps, so nothing can be traced back."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        return secrets.token_bytes(32)
    if len(key.encode()) < 16:
        raise ValueError(f"{KEY_SETTING} must have 16 bytes at least")
    return key.encode()


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data under pseudonyms; n_chars follows the new text.

    Null and empty texts stay as they are; equal values have equal pseudonyms in every row, repeated rows stay equal; an
    empty table stays empty; all columns come back.
    """
    out = pii.pseudonymise(docs, pseudonym_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs)) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them.

    Null texts count as empty (no tokens), very long ones are encoded whole; one row comes back for each given,
    repeated ones too; other columns go; an empty table gives an empty result.
    """
    return bpe.encode_digest(docs, queries.bpe_path())


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaked),
    ("personal_data", hide_personal_data),
    ("tokens", tokenise),
]

#: A learned score and a token table cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared scratch folder."""
    docs = _io.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = _io.cut(out) if i < len(STAGES) - 1 else out
    return docs
