"""Quality gates and checks of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def noise_share(text: Column) -> Column:
    """Share of characters outside printable ASCII; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[ -~]", "")) / F.length(text)).otherwise(F.lit(0.0))


def top_word_count(words: Column) -> Column:
    """How often the most frequent word occurs, in any case, by runs of the sorted words."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(acc, w):
        n = F.when(acc["w"] == w, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(acc["best"], n).alias("best"))

    return F.aggregate(F.array_sort(F.transform(words, F.lower)), start, step)["best"]


def reason(df: DataFrame, text: str, min_words: int, letters: float | None = None, noise: float = 0.15, top: float = 0.5) -> DataFrame:
    """Adds reason: the first rule that a text breaks (too_short, noisy, repetitive, few_letters), null if none."""
    d = df.withColumn("words_", T.words(F.col(text)))
    d = d.withColumn("top_", top_word_count(F.col("words_")))
    n = F.size("words_")
    rule = F.when(n < min_words, "too_short").when(noise_share(F.col(text)) > noise, "noisy").when(F.col("top_") > top * n, "repetitive")
    if letters is not None:
        rule = rule.when(F.length(F.regexp_replace(F.col(text), r"[^A-Za-z]", "")) < letters * F.length(text), "few_letters")
    return d.withColumn("reason", rule).drop("words_", "top_")


def retired_fields(rows: DataFrame, metadata: str, fields: Sequence[str]) -> DataFrame:
    """One row: n, for each retired field the number of rows whose metadata (JSON text) still have it, and any_of_them."""
    has = {f: F.get_json_object(metadata, f"$.{f}").isNotNull() for f in fields}
    some = F.lit(False)
    for c in has.values():
        some = some | c
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f) for f, c in has.items()], F.count_if(some).alias("any_of_them"))
