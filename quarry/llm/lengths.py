"""Exact length histogram: what every context limit keeps and cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.common import materialize

#: Lengths of one block of the two-level sums.
BLOCK = 1024


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: documents of each length; rows without a length are left out."""
    return lengths.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def totals(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as context limit, from suffix sums over the histogram:

    context_limit, n_docs (of that length), docs_over (longer), docs_within, tokens_total (of all documents),
    tokens_over (of the longer ones), tokens_within, tokens_truncated (what is kept when each document is cut
    at the limit), share_docs_within (which makes the limit the quantile of that share). An empty table gives no rows.

    Sums run in two levels: over blocks of lengths, then inside a block, so no task gets the whole histogram.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("bd").over(every).alias("docs"),
        F.sum("bt").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = h.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("docs_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("tokens_later") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_over"),
        "docs",
        "tokens_total",
    )
    return over.select(
        "context_limit",
        "n_docs",
        "docs_over",
        (F.col("docs") - F.col("docs_over")).alias("docs_within"),
        "tokens_total",
        "tokens_over",
        (F.col("tokens_total") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")).alias("tokens_truncated"),
        ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("share_docs_within"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept when each document is cut at any limit, which need not occur as a length."""
    below = F.col("context_limit") <= limit
    return sums.agg(
        (F.coalesce(F.max_by(F.when(below, F.col("tokens_within")), F.when(below, F.col("context_limit"))), F.lit(0))
         + limit * F.coalesce(F.sum(F.when(~below, F.col("n_docs"))), F.lit(0))).alias("tokens_truncated")
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the least length within which that share of the documents lies; null for an empty table."""
    return sums.where(F.col("share_docs_within") >= share).agg(F.min("context_limit").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """totals() over the encoded lengths of every whole text; a null or empty text has length 0. The histogram, one row for
    each length, is written once, as totals() reads it twice. Rows that repeat each count; other columns are left out."""
    return totals(materialize(histogram(bpe.lengths(docs, path)), "lengths"))
