"""An inverted index for substring search: character n-grams lead to words, words to the chunks that hold them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import counted
from quarry.sources.scratch import scratch_dir

#: Characters of a gram, and folders into which grams and words are dealt, so that a search reads only those it asks for.
GRAM = 3
BUCKETS = 32


@dataclass
class TermIndex:
    """grams: gram, word, bucket (of the gram); postings: word, id, n, bucket (of the word); words: word."""

    grams: DataFrame
    postings: DataFrame
    words: DataFrame


def bucket(of: str):
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("int")


def grams_of(word: str):
    """The distinct runs of GRAM characters of a column; none if it is shorter."""
    last = F.length(word) - (GRAM - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(word), i, F.lit(GRAM))))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder with a folder for each bucket; rows of a bucket are dealt over the tasks."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.repartition("bucket").write.partitionBy("bucket").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(chunks: DataFrame) -> TermIndex:
    """The index of the lower-cased texts (id, text), whose words stand between spaces."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    counts = chunks.select("id", F.explode(counted(words)).alias("c")).select(F.col("c.word").alias("word"), "id", (-F.col("c.less")).cast("bigint").alias("n"))
    postings = _stored(counts.withColumn("bucket", bucket("word")), "postings")
    vocabulary = postings.select("word").distinct()
    grams = _stored(vocabulary.select("word", F.explode(grams_of("word")).alias("gram")).select("gram", "word", bucket("gram").alias("bucket")), "grams")
    return TermIndex(grams, postings, vocabulary)


def occurrences(index: TermIndex, strings: DataFrame, chunks: DataFrame) -> DataFrame:
    """string, id, n: how often each of a stated set of lower-case strings (string) stands in the chunks (id, text) that hold it.

    The words that hold all grams of a string are read off the grams' folders and confirmed; then the postings of these words
    give the chunks and the counts, so a search reads what it matches, not all texts. Strings shorter than a gram are looked up
    in the words themselves. Only strings with a space, which may go across words, are looked up in the texts."""
    s = strings.select("string").where("string is not null and string <> ''").distinct()
    spaced = F.contains(F.col("string"), F.lit(" "))
    own = s.where(~spaced)
    asked = own.where(F.length("string") >= GRAM).withColumn("grams", grams_of("string"))
    asked = asked.select("string", F.size("grams").alias("need"), F.explode("grams").alias("gram")).withColumn("bucket", bucket("gram"))
    held = index.grams.join(F.broadcast(asked), ["bucket", "gram"]).groupBy("string", "word").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need"))
    found = held.where("k = need").select("string", "word").where(F.contains("word", F.col("string")))
    short = index.words.join(F.broadcast(own.where(F.length("string") < GRAM)), F.contains("word", F.col("string"))).select("string", "word")
    times = lambda text: ((F.length(text) - F.length(F.replace(F.col(text), F.col("string"), F.lit("")))) / F.length("string")).cast("long")
    matched = found.unionByName(short).withColumn("times", times("word")).withColumn("bucket", bucket("word"))
    within = index.postings.join(matched, ["bucket", "word"]).groupBy("string", "id").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    low = chunks.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    across = low.join(F.broadcast(s.where(spaced)), F.contains("low", F.col("string"))).select("string", "id", times("low").alias("n"))
    return within.unionByName(across)
