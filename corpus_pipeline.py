"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the next stage's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, minhash, mixing, quality, suffix
from quarry.llm.common import id_key, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their own columns. A document is known by its id and text, so rows that
    repeat both share a verdict, and rows with a null id are judged like others; null and empty texts are rejected."""
    labels = table(spark, sf_dir, "labels")
    kept = quality.verdicts(docs, quality.trusted_rows(labels), keep_text_hash=True).where("kept")
    kept = kept.select(id_key(F.col("doc_id")).alias("d_"), F.col("text_hash").alias("h_")).distinct()
    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), id_key(F.col("doc_id")).alias("d_"), hashed.alias("h_"))
    return own.join(kept, ["d_", "h_"], "left_semi").select("row_.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id (null last); texts without words are one group, rows that
    repeat id and text one document. Very long texts are compared whole; an empty table gives no rows; other columns stay, whatever
    their names."""
    return minhash.dedup(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier in the corpus; those that lose all bytes go. A null text
    stays null, a null id comes first, rows that repeat id and text lose the same bytes. Very long texts are read whole; an empty table
    gives no rows; other columns stay, whatever their names."""
    return suffix.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that one seeded epoch takes to fill each leaf's budget; at a budget's end the last one stays whole. Null
    languages and sources are a leaf like others; a text without words takes nothing and stays if its place is before the end. Rows that
    repeat each have a place. Very long texts are counted whole; an empty table gives no rows; other columns stay, whatever their
    names."""
    return mixing.chosen(docs, mixing.Targets(max_epochs=1))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left, a row for each row, repeated ones too; a null text has no tokens.
    Very long texts are encoded whole; an empty table gives no rows; columns other than doc_id and text are left out."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix_sources),
    ("bpe encoding and decoding", encode),
]

#: SQL has no BagMinHash, byte windows or BPE; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
