"""Duplicates among chunks, results and learned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list, *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def exact(chunks: DataFrame) -> DataFrame:
    """Within a document the first chunk of each text."""
    return first_of(chunks, ["doc_id", F.sha2("text", 256)], "k")


def against(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks whose text is neither in the index nor earlier in the batch."""
    h = F.sha2("text", 256)
    fresh = new.withColumn("h_", h).join(old.select(F.sha2("text", 256).alias("h_")).distinct(), "h_", "left_anti")
    return first_of(fresh, ["h_"], "id").drop("h_")


def keyword_set(df: DataFrame, key: str, words: Column, most: int = 20) -> DataFrame:
    """key, word, n: the most frequent words of each text."""
    counts = df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))).where(F.col("r") <= most).drop("r")


def sharing(asked: DataFrame, known: DataFrame, key: str, other: str, word: str, least: int) -> DataFrame:
    """key, other, n: the pairs with at least `least` common words of asked (key, word; few for a key) and known (other, word).

    Such a pair shares one of the key's words beyond its least - 1 commonest, so only these meet all rows that have them; the
    commonest words of a key are looked up for the pairs found, by other and word, which no row has twice."""
    often = known.groupBy(word).agg(F.count(F.lit(1)).alias("n_"))
    ranked = asked.join(often, word).withColumn("nth_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_"), word)))
    rare, common = ranked.where(F.col("nth_") >= least).select(key, word), ranked.where(F.col("nth_") < least).select(key, word)
    met = rare.join(known, word).groupBy(key, other).agg(F.count(F.lit(1)).alias("rare_"))
    more = met.join(common, key).join(known, [other, word]).groupBy(key, other).agg(F.count(F.lit(1)).alias("common_"))
    n = F.col("rare_") + F.coalesce("common_", F.lit(0))
    return met.join(more, [key, other], "left").select(key, other, n.alias("n")).where(F.col("n") >= least)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(F.lit(0.0))
