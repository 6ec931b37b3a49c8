"""File sources and sinks: chunk indexes as JSON lines and Parquet, text, CSV drops, tables over JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("element_type", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("search_keywords", T.ArrayType(T.StringType())), T.StructField("search_text", T.StringType()),
    T.StructField("related_chunks", T.ArrayType(T.StringType())), T.StructField("topic_cluster_id", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("nlp_category", T.StringType()), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType())])),
])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank and malformed lines and rows without an id are left out."""
    schema = T.StructType([*CHUNK.fields, T.StructField("bad_", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "bad_").json(path)
    return rows.where(F.col("bad_").isNull() & F.col("id").isNotNull() & (F.col("id") != "")).drop("bad_")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """path, file (its name), text of whole .txt and .md files."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """key, length, modified, hash (MD5 of the content) of files below a path, by suffix."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = rows.where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    return named.select(F.col("path").alias("key"), "length", F.col("modificationTime").alias("modified"), F.md5("content").alias("hash"))


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    """One row: the newest file of a folder."""
    rows = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return rows.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def validate_csv(df: DataFrame, required: Sequence[str]) -> tuple[bool, str]:
    """Whether the required columns and at least one row are there, and what is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        return False, "missing columns: " + ", ".join(missing)
    return (False, "no rows") if df.isEmpty() else (True, "")


def read_tickets_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A ticket table of a database server over JDBC; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_by_category(chunks: DataFrame, path: str) -> None:
    """Chunks in a folder for each category; only the categories written are replaced."""
    named = chunks.withColumn("nlp_category", F.coalesce(F.col("metadata.nlp_category"), F.lit("general")))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("nlp_category").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_vectors(rows: DataFrame, vectors: DataFrame, payload: Sequence[str], key: str, path: str) -> None:
    """Rows with the listed payload columns and the vector that the caller supplies by `key` (key, vector), appended."""
    append(rows.join(vectors, key).select(*payload, "vector"), path)


def rebuild(index: DataFrame, path: str) -> None:
    """Discards what is at a path and writes the index anew."""
    index.write.mode("overwrite").parquet(path)
