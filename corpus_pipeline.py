"""A training corpus in five stages; each is written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe, decontam, neardup, quality, suffix
from aerolith.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that break a rule go, so do rows without a text. Repeated rows are judged alike, columns stay as they are."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest doc_id; of equal rows one.

    Rows that share a doc_id, or have none, are told apart by their texts. Columns stay as they are.
    """
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus are cut out; n_chars follows the text. No row goes.

    A null text becomes an empty one. Repeated rows are one document and cut alike. Other columns travel in one struct,
    so their names don't matter.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("others"))
    out = suffix.dedup(rows, more=("others",)).select("doc_id", "text", *(F.col("others")[c].alias(c) for c in others))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, or a copy with a tenth of its bytes edited at most, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers), a row for each row.

    A null or empty text has no ids. Repeated rows, rows that share a doc_id and rows without one are encoded each on its
    own; a text of any length is one row's work. No rows give none. Other columns are not read.
    """
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, at_spaces=True, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", decontaminate),
    ("byte_bpe", encode),
]

#: SQL can't express hashing, cutting and merging as these stages do; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
