"""Exact duplicates of whole texts, in DataFrame functions only: salted digest groups whose contents are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_key, materialize

#: A digest that more than this share of the rows have (and more than LEAST rows) is hot: fewer than HOT digests are.
HOT, LEAST = 1000, 64
#: Parts that a hot digest's rows are dealt into.
SALTS = 32
#: The digest, and a second one that tells most texts of one digest apart before their contents do.
KEYS = ["text_sha256", "check"]


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digested(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"text_sha256": digest(F.col("text")), "check": F.xxhash64("text")})


def winners(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """*KEYS, keep_id, group_size of each text: its largest doc_id and number of rows (rows: doc_id, text, *KEYS; hot: *KEYS of
    fewer than HOT digests).

    Rows are grouped by digest, salt and text, so Spark merges copies inside each task first (one row of a task at most for a
    hot text), then those of one salt, comparing contents as keys both times. A digest that isn't hot has one salt and is done.
    The winners of a hot digest's salts, SALTS at most for each text, are then combined by digest and text."""
    salt = F.when(F.col("hot"), F.spark_partition_id() % SALTS).otherwise(-1)
    salted = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), KEYS, "left").withColumn("salt", salt)
    merged = salted.groupBy(*KEYS, "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = materialize(merged.withColumn("text", F.when(F.col("salt") >= 0, F.col("text"))), "salt-winners")
    combined = merged.where("salt >= 0").groupBy(*KEYS, "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    columns = [*KEYS, "keep_id", "group_size"]
    return merged.where("salt < 0").select(columns).unionByName(combined.select(columns))


def by_content(docs: DataFrame, clashing: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The result's rows for different texts that share both digests, told apart by their contents."""
    rows = digested(docs, digest).join(clashing, KEYS, "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "clashing")
    of = rows.groupBy(*KEYS, "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("head"))
    found = rows.join(of, [*KEYS, "text"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("head")).alias("kept"), "text_sha256")


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs.

    Texts are equal if they are identical; null counts as empty, very long texts are compared whole. Of equal texts the row
    with the largest doc_id stays (a null id only if all are null); of rows that repeat both id and text exactly one is kept.
    Columns other than doc_id and text are left out; an empty table gives no rows.

    Texts move once through a shuffle (see winners()); after that only digests do. Each row finds its text's winner by the
    digests: those of hot texts are broadcast (fewer than HOT rows), so no task gets a hot text's rows. Should different texts
    share both digests, their rows are joined by content."""
    rows = digested(docs, digest)
    listed = materialize(rows.select("doc_id", *KEYS).withColumn("row", F.monotonically_increasing_id()), "digests")
    heads = listed.groupBy(KEYS).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("head"))
    heads = materialize(heads, "heads")
    hot = heads.where(F.col("n") > max(listed.count() // HOT, LEAST)).select(KEYS)
    groups = materialize(winners(rows, hot), "winners")
    clashing = groups.groupBy(KEYS).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(KEYS)
    clash = not clashing.isEmpty()
    if clash:
        groups = groups.join(clashing, KEYS, "left_anti")
    columns = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("head")).alias("kept"), "text_sha256"]
    found = groups.join(heads.select(*KEYS, "head"), KEYS)
    few = F.broadcast(hot)
    cold = listed.join(few, KEYS, "left_anti").join(found.join(few, KEYS, "left_anti"), KEYS).select(columns)
    warm = listed.join(F.broadcast(found.join(few, KEYS, "left_semi")), KEYS).select(columns)
    both = cold.unionByName(warm)
    return both.unionByName(by_content(docs, clashing, digest)) if clash else both


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that duplicates() keeps, with their own columns; one row for each text."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), id_key(F.col("doc_id")).alias("d_"), sha256(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("s_"))
    kept = duplicates(docs).where("kept").select(id_key(F.col("doc_id")).alias("d_"), F.col("text_sha256").alias("s_"))
    return own.join(kept, ["d_", "s_"], "left_semi").dropDuplicates(["d_", "s_"]).select("row_.*")
