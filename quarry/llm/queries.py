"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact, html, lengths, minhash, mixing, negatives, ngrams, phrases, quality, simhash, suffix, toxicity
from quarry.llm.common import table

BPE_FILE = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), quality.trusted_rows(table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scores(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_quality_rules, op4_html_extraction, op5_bpe, op6_lm_scoring, op7_minhash_near_dedup, op8_mixing, op9_simhash, op10_token_counts, op11_exact_dedup, op12_collocations, op13_hard_negatives)}
ORACLES: dict[str, str] = {
    "op11_exact_dedup": """
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from (
            select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, sha256(text) as text_sha256
            from (select doc_id, coalesce(text, '') as text from documents) window w as (partition by text))""",
}
