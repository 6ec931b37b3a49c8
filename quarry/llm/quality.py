"""Quality rules: surface counts of a text, and the hashed n-gram log-likelihood ratio between
a trusted target and the raw corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, words_of

SYMBOLS = "#*$%&|<>"
#: Buckets of the hashed multinomials; the table of their ratios is broadcast, so this bounds its size.
BUCKETS = 1 << 13
#: Trusted documents that the target multinomial is learned from, at most, by the order of a hash of their ids.
TRUSTED_ROWS = 20_000
#: A text is kept if its mean log ratio is at least this.
LEAST_RATIO = -0.1
#: Ratios are summed as whole numbers of this fraction, so that sums don't depend on their order.
UNIT = 1_000_000


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from `words`: words inside 5-word windows that occur at least twice in the text.

    Windows are compared by a hash first; only texts where two hashes agree compare the words themselves,
    by sorting their windows and looking at neighbours."""
    df = df.withColumn("n5", F.greatest(F.size("words") - 4, F.lit(0)))
    windows = F.arrays_zip(*[F.slice("words", k + 1, F.col("n5")) for k in range(5)])
    df = df.withColumn("hashes", F.transform(windows, lambda x: F.xxhash64(x)))
    df = df.withColumn("again", F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False))).drop("hashes")
    only = lambda e: F.expr(f"if(again, {e}, null)")
    df = df.withColumn("sorted", only("array_sort(transform(sequence(1, n5), i -> struct(concat_ws(' ', slice(words, i, 5)) as k, i as i)))"))
    df = df.withColumn("same", only("zip_with(slice(sorted, 1, n5 - 1), slice(sorted, 2, n5 - 1), (a, b) -> a.k = b.k)"))
    df = df.withColumn("starts", only("array_sort(filter(transform(sorted, (x, j) -> if(coalesce(get(same, j), false) or coalesce(get(same, j - 1), false), x.i, null)), i -> i is not null))"))
    df = df.withColumn("gaps", only("zip_with(slice(starts, 1, greatest(size(starts) - 1, 0)), slice(starts, 2, greatest(size(starts) - 1, 0)), (a, b) -> least(b - a, 5))"))
    n = F.expr("if(again and size(starts) > 0, 5 + aggregate(gaps, 0, (a, g) -> a + g), 0)").cast("long")
    return df.withColumn("n_repeat_words", F.coalesce(n, F.lit(0))).drop("n5", "again", "sorted", "same", "starts", "gaps")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"), words_of(text).alias("words")).withColumn("text_hash", F.xxhash64("text"))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id",
        "text_hash",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", "[" + SYMBOLS + "]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    df = _repeated_words(df)
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def pairs(words: Column) -> Column:
    """Each word with the one after it (null after the last), as an array of structs a, b."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def bucket(*words: Column, buckets: int) -> Column:
    """The bucket of a word, or of a pair of neighbouring words (null without the second)."""
    there = words[-1].isNotNull()
    return F.when(there, F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int"))


def ratio_table(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, ratio: round(UNIT * ln(p_target / p_raw)) with one added to each count, over all documents.
    Null texts have no words, null ids are never trusted; rows that repeat count as often as they stand."""
    trusted = F.broadcast(trusted_ids.select(F.col("doc_id").alias("tid")).distinct())
    texts = docs.select("doc_id", words_of(F.col("text").cast("string")).alias("words"))
    rows = texts.join(trusted, texts["doc_id"] == trusted["tid"], "left").select(F.col("tid").isNotNull().alias("t"), F.inline(pairs(F.col("words"))).alias("a", "b"))
    one = bucket(F.col("a"), buckets=buckets)
    two = bucket(F.col("a"), F.col("b"), buckets=buckets)
    hashed = rows.select("t", F.stack(F.lit(2), one, two).alias("bucket")).where(F.col("bucket").isNotNull())
    counts = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("t").alias("target"))
    sums = counts.agg(F.sum("raw").alias("raw_all"), F.sum("target").alias("target_all"))
    ratio = F.log((F.col("target") + 1) / (F.col("target_all") + buckets)) - F.log((F.col("raw") + 1) / (F.col("raw_all") + buckets))
    return counts.crossJoin(F.broadcast(sums)).select("bucket", F.round(ratio * UNIT).cast("long").alias("ratio"))


def trusted_rows(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """The ids of the rows labelled as of good quality and not toxic; at most `most` of them, by a hash of the id."""
    good = labels.where((F.col("quality") == 1) & F.coalesce(F.col("toxic") != 1, F.lit(True)) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def verdicts(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, least: float = LEAST_RATIO, keep_text_hash: bool = False) -> DataFrame:
    """The counts of base_counts() without the words, then llr (mean log ratio of the text's words and word pairs;
    0 where there are none) and kept: not base_failed and llr at least `least`.

    A null or empty text has no words and fails the base rule; repeated rows each give a row, also with a null doc_id;
    where no document is trusted every ratio is that of the smoothing alone; an empty table gives no rows."""
    from quarry.llm.common import materialize

    ratios = materialize(ratio_table(docs, trusted_ids, buckets), "ratios")  # at most `buckets` rows
    base = base_counts(docs).withColumn("rid", F.monotonically_increasing_id())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"] + ["text_hash"] * keep_text_hash
    rows = base.select("rid", *columns, F.inline_outer(pairs(F.col("words"))).alias("a", "b"))
    of = lambda name: F.broadcast(ratios.select(F.col("bucket").alias(name), F.col("ratio").alias(f"{name}_ratio")))
    rows = rows.select("rid", *columns, bucket(F.col("a"), buckets=buckets).alias("one"), bucket(F.col("a"), F.col("b"), buckets=buckets).alias("two"))
    scored = rows.join(of("one"), "one", "left").join(of("two"), "two", "left").groupBy("rid").agg(
        *[F.first(c).alias(c) for c in columns],  # plain numbers, so that the sums stay in a hash table
        F.coalesce(F.sum(F.coalesce("one_ratio", F.lit(0)) + F.coalesce("two_ratio", F.lit(0))), F.lit(0)).alias("total"),
        (F.count("one") + F.count("two")).alias("n"),
    )
    llr = F.when(F.col("n") > 0, F.col("total") / F.col("n") / UNIT).otherwise(F.lit(0.0))
    return scored.select(*columns, llr.alias("llr")).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))
