"""Shared helpers of the training-data operators: tables, scratch tables, columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.scratch import written

#: White space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The odd multiplier of splitmix64.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back, which cuts the lineage
    and lets a lost executor's work restart from the files. rows: a bound of its rows, see written()."""
    return written(df, name, rows)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Word hashes that a task remembers; it starts afresh beyond `most`, which bounds its memory."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word) or 1
        return found


#: What forgets that which a Python worker remembers between the tasks of an operator.
MEMORIES: dict[str, Callable[[], None]] = {}


def forget_others(owner: str) -> None:
    for name, forget in MEMORIES.items():
        if name != owner:
            forget()


def give_back() -> None:
    """Gives freed pages back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def released(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], owner: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run for mapInPandas, with less memory of idle workers: Spark keeps workers for later stages, so a task first forgets what
    other operators than its owner remember there, and gives freed pages back when it ends."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


@F.pandas_udf(T.BinaryType())
def zipped(texts: pd.Series) -> pd.Series:
    """The compressed UTF-8 bytes of each text (null: empty), to move less in a shuffle."""
    z = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([z((t or "").encode("utf-8")) for t in texts], dtype=object)


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def id_key(doc_id: Column) -> Column:
    """A doc_id as a join key that null has too."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))
