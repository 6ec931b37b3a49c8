"""Exact nearest vectors: blocks of queries meet blocks of vectors, and a bounded number of best rows of each leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import written

#: Vectors of a block, about: what a task holds at a time; and queries that are sent together.
VECTORS, QUERIES = 4096, 256
#: Digits of a similarity.
DIGITS = 6


def units(vectors) -> np.ndarray:
    """Vectors of length 1, a zero vector as it is."""
    v = np.stack([np.asarray(x, float) for x in vectors])
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _met(queries: DataFrame, vectors: DataFrame, group: str | None, other: bool, prefer: Column | None, most: int | None, block: int, together: int) -> DataFrame:
    """query_id, vec_id, similarity, preferred: for each query and block of vectors the best `most` rows, or all.

    Vectors (vec_id, embedding) move once, to their block; queries go to each block in packed rows. Blocks and packs have a
    fixed size, whatever the sizes of both sides, and nothing is broadcast. With a group column only rows of the query's group
    meet, or only those of others; it is no join key, so a large group is not one task."""
    of = F.col(group).cast("string") if group else F.lit("")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    v = vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), of.alias("of"), (F.coalesce(prefer, F.lit(False)) if prefer is not None else F.lit(False)).alias("preferred"))
    q = queries.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), of.alias("of"))
    v, q = written(v, "vectors"), written(q, "queries")
    blocks, packs = max(math.ceil(v.count() / block), 1), max(math.ceil(q.count() / together), 1)
    # a pack's rows are hashed to it, so no group grows with the table
    packed = q.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs))).groupBy("pack").agg(F.collect_list(F.struct("vec_id", "of", "embedding")).alias("queries"))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "queries")
    none = lambda kind: F.lit(None).cast(kind)
    queries_kind = sent.schema["queries"].dataType
    rows = v.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "of", "preferred", "embedding", none(queries_kind).alias("queries"))
    asks = sent.select("block", F.lit(1).alias("asks"), F.lit(0).cast("bigint").alias("vec_id"), F.lit("").alias("of"), F.lit(False).alias("preferred"), none("array<double>").alias("embedding"), "queries")

    def answer(parts: list[pd.DataFrame], packs: Iterator) -> Iterator[pd.DataFrame]:
        b = pd.concat(parts)
        unit, ids, of, preferred = units(b["embedding"]), b["vec_id"].to_numpy(np.int64), b["of"].to_numpy(object), b["preferred"].to_numpy(bool)
        for pack in packs:
            score = np.round(units([x["embedding"] for x in pack]) @ unit.T, DIGITS) + 0.0
            found = []
            for x, s in zip(pack, score, strict=True):
                may = ids != x["vec_id"]
                if group:
                    may &= (of != x["of"]) if other else (of == x["of"])
                at = np.flatnonzero(may)
                if most is not None and len(at) > most:
                    at = at[np.lexsort((ids[at], -s[at], ~preferred[at]))[:most]]
                found.append(pd.DataFrame({"query_id": x["vec_id"], "vec_id": ids[at], "similarity": s[at], "preferred": preferred[at]}))
            yield pd.concat(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts = None, []
        for batch in batches:
            for (number, is_ask), part in batch.groupby(["block", "asks"], sort=True):
                if number != current:
                    current, parts = number, []
                if not is_ask:
                    parts.append(part)
                elif parts:
                    yield from answer(parts, part["queries"])

    met = rows.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks")
    return met.mapInPandas(run, "query_id bigint, vec_id bigint, similarity double, preferred boolean")


def similarities(queries: DataFrame, vectors: DataFrame, group: str | None = None, other: bool = False, block: int = VECTORS, together: int = QUERIES) -> DataFrame:
    """query_id, vec_id, similarity: each query vector (vec_id, embedding) with all other vectors, or those of its group (or of
    others); cosines with DIGITS digits, 0 where a norm is 0."""
    return _met(queries, vectors, group, other, None, None, block, together).drop("preferred")


def nearest(
    queries: DataFrame, vectors: DataFrame, most: int, group: str | None = None, other: bool = False, prefer: Column | None = None, block: int = VECTORS, together: int = QUERIES
) -> DataFrame:
    """query_id, vec_id, similarity, r: the `most` best of similarities() for each query, ties to the smaller vec_id; rows for
    which `prefer` holds come first. Each block gives at most `most` rows for a query, and these are ranked again."""
    met = _met(queries, vectors, group, other, prefer, most, block, together)
    order = Window.partitionBy("query_id").orderBy(F.desc("preferred"), F.desc("similarity"), "vec_id")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query_id", "vec_id", "similarity", "r")


def nearest_sharing(queries: DataFrame, vectors: DataFrame, least: int, block: int = VECTORS) -> DataFrame:
    """query_id, vec_id, similarity: for each query (vec_id, embedding, words) the most similar of the vectors (vec_id, embedding,
    words) that share `least` words with it, ties to the smaller vec_id; words are arrays of codes without repeats.

    Vectors move once, to their block of a fixed size; queries go to each block. There a query's rows are tried from the most
    similar on until one shares the words, so no pairs leave a block but each query's best row."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    shape = [F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("words").cast("array<bigint>").alias("words")]
    v, q = written(vectors.where(usable).select(shape), "vectors"), written(queries.where(usable).select(shape), "queries")
    blocks = max(math.ceil(v.count() / block), 1)
    held = v.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), *v.columns)
    sent = q.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), *q.columns)

    def answer(unit: np.ndarray, ids: np.ndarray, words: list, asks: pd.DataFrame) -> Iterator[tuple[int, int, float]]:
        for first in range(0, len(asks), QUERIES):
            part = asks.iloc[first : first + QUERIES]
            for x, own, s in zip(part["vec_id"], part["words"], np.round(units(part["embedding"]) @ unit.T, DIGITS) + 0.0, strict=True):
                own = set(own.tolist())
                for k in np.lexsort((ids, -s)) if len(own) >= least else ():
                    if len(own.intersection(words[k].tolist())) >= least:
                        yield x, ids[k], s[k]
                        break

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts, of = None, [], None
        for batch in batches:
            for (number, is_ask), part in batch.groupby(["block", "asks"], sort=True):
                if number != current:
                    current, parts, of = number, [], None
                if not is_ask:
                    parts.append(part)
                elif parts or of:
                    if of is None:
                        b = pd.concat(parts)
                        of, parts = (units(b["embedding"]), b["vec_id"].to_numpy(np.int64), b["words"].tolist()), []
                    yield pd.DataFrame(list(answer(*of, part)), columns=["query_id", "vec_id", "similarity"])

    met = held.unionByName(sent).repartition("block").sortWithinPartitions("block", "asks").mapInPandas(run, "query_id bigint, vec_id bigint, similarity double")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return met.withColumn("r", first).where("r = 1").drop("r")
