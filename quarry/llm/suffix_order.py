"""The whole corpus in suffix order, by the difference-cover algorithm in rounds of Spark sorts, without any hash.

This is the dealt method of suffix-array dedup in its plain form: the triples at positions 1 and 2 modulo 3 are sorted and
named, the names are ordered in the same way until they differ, the other suffixes are merged in, and neighbours in the
order are compared. Each round sorts two rows for three bytes; README states what that costs. suffix.py gives the same
windows from far less."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.suffix import WINDOW, suffix_ranks

#: Symbols that one task orders on its own, where the recursion ends.
LOCAL = 1 << 18
#: Positions of one block in which neighbours are looked up.
BLOCK = 1 << 16


def places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with place: the number of the row's keys among all keys in order, from 1; equal keys share it. Keys are dealt out
    by ranges and sorted inside; a range's first number is the sum of the sizes of those before it, one row for each range."""
    kinds = rows.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = materialize(kinds.select(*keys, F.spark_partition_id().alias("range_"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("in_")), "sorted")
    size = kinds.groupBy("range_").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(kinds.join(size.select("range_", before.alias("before_")), "range_").select(*keys, (F.col("before_") + F.col("in_") + 1).alias("place")), keys)


def with_next(rows: DataFrame, column: str, names: list[str], absent: int = 0) -> DataFrame:
    """rows (pos, column) with the column's values at the next positions. A block borrows the first rows of the one after it."""
    block = F.floor(F.col("pos") / BLOCK)
    lent = F.when(F.col("pos") % BLOCK < len(names), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = rows.withColumn("block_", F.explode(lent))
    w = Window.partitionBy("block_").orderBy("pos")
    out = dealt.select("*", *[F.coalesce(F.lead(column, k + 1).over(w), F.lit(absent)).alias(name) for k, name in enumerate(names)])
    return out.where(F.col("block_") == block).drop("block_")


def ranks(symbols: DataFrame, n: int) -> DataFrame:
    """pos, rank of each suffix of the n symbols (pos from 0 without gaps, c above 0)."""
    if n <= LOCAL:

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos")
            return pd.DataFrame({"pos": rows["pos"], "rank": suffix_ranks(np.unique(rows["c"].to_numpy(), return_inverse=True)[1] + 1)})

        return symbols.groupBy(F.lit(0).alias("all_")).applyInPandas(run, "pos bigint, rank bigint")
    triples = materialize(with_next(symbols, "c", ["c1", "c2"]), "triples")
    kind = F.col("pos") % 3
    extra = int(n % 3 == 1)  # one more place, so that the positions 1 modulo 3 end with an empty suffix
    ones = len(range(1, n + extra, 3))
    sample = triples.where(kind != 0).select("pos", "c", "c1", "c2")
    if extra:
        sample = sample.union(symbols.sparkSession.createDataFrame([(n, 0, 0, 0)], "pos bigint, c bigint, c1 bigint, c2 bigint"))
    named = materialize(places(sample, ["c", "c1", "c2"]).select("pos", "place"), "named")
    size = n - len(range(0, n, 3)) + extra
    if named.agg(F.max("place")).first()[0] < size:
        at = F.floor(F.col("pos") / 3) + F.when(kind == 2, ones).otherwise(0)
        deeper = ranks(named.select(at.alias("pos"), F.col("place").alias("c")), size)
        back = F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        named = deeper.select(back.alias("pos"), F.col("rank").alias("place"))
    rank = materialize(named.select("pos", (F.col("place") - extra).alias("r")), "ranked")
    own = with_next(triples.select("pos", "c", "c1").join(rank, "pos", "left").withColumn("r", F.coalesce("r", F.lit(0))), "r", ["r1", "r2"])
    own = materialize(own, "own")
    zero, one, two = (own.where(kind == k) for k in range(3))
    ends = {1: ["c", "r1"], 2: ["c", "c1", "r2"]}  # what tells a suffix at 0 modulo 3 from one at 1, at 2
    merged = {k: materialize(places(zero.union(x).select("pos", *ends[k]), ends[k]).select("pos", F.col("place").alias(f"p{k}")), "merged") for k, x in ((1, one), (2, two))}
    alone = lambda x, keys: places(x.select("pos", *keys), keys).select("pos", F.col("place").alias("p0"))
    of_zero = alone(zero, ends[1]).join(merged[1], "pos").join(merged[2], "pos").select("pos", (F.col("p1") + F.col("p2") - F.col("p0")).alias("rank"))
    of = [x.select("pos", "r").join(alone(x, ["r"]), "pos").join(merged[k], "pos").select("pos", (F.col("r") + F.col(f"p{k}") - F.col("p0")).alias("rank")) for k, x in ((1, one), (2, two))]
    return of_zero.union(of[0]).union(of[1])


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start of the windows that an earlier one equals (docs: doc_id, text; ids differ). Null texts are empty."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    sizes = materialize(docs.select("doc_id", (size + 1).alias("size")), "sizes")
    placed = places(sizes, ["doc_id"])
    block = F.floor(F.col("place") / BLOCK)
    sums = placed.groupBy(block.alias("b")).agg(F.sum("size").alias("s"))
    until = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("b", F.coalesce(F.sum("s").over(until), F.lit(0)).alias("base"))
    inside = Window.partitionBy("b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("b", block).join(sums, "b").select("doc_id", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("first"))
    total = sizes.agg(F.sum("size")).first()[0] or 0

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, at, t in zip(b["doc_id"], b["first"], b["text"], strict=True):
                raw = (t or "").encode()
                c = np.concatenate([np.frombuffer(raw, np.uint8).astype(np.int64) + 2, [1]])
                start = np.arange(len(c))
                yield pd.DataFrame({"pos": at + start, "c": c, "doc_id": d, "start": start, "prefix": [raw[i : i + window] if i + window <= len(raw) else None for i in range(len(c))]})

    cells = docs.join(first, "doc_id").select("doc_id", "first", F.col("text").cast("string").alias("text")).mapInPandas(cut, "pos bigint, c bigint, doc_id bigint, start bigint, prefix binary")
    cells = materialize(cells, "cells")
    if not total:
        return cells.select("doc_id", "start")
    order = ranks(cells.select("pos", "c"), int(total))
    whole = cells.where("prefix is not null").join(order, "pos")
    # suffixes that start with the same window are neighbours; each is compared with the one before it
    lined = places(whole.select("rank", "pos", "doc_id", "start", "prefix"), ["rank"]).select((F.col("place") - 1).alias("pos"), F.col("pos").alias("at"), "doc_id", "start", "prefix")
    lent = F.when(F.col("pos") % BLOCK == BLOCK - 1, F.array(F.floor(F.col("pos") / BLOCK), F.floor(F.col("pos") / BLOCK) + 1)).otherwise(F.array(F.floor(F.col("pos") / BLOCK)))
    w = Window.partitionBy("b").orderBy("pos")
    seen = lined.withColumn("b", F.explode(lent)).withColumn("new", ~F.coalesce(F.lag("prefix").over(w) == F.col("prefix"), F.lit(False)))
    seen = materialize(seen.where(F.col("b") == F.floor(F.col("pos") / BLOCK)).select("b", "pos", "at", "doc_id", "start", "new"), "compared")
    per = seen.groupBy("b").agg(F.count_if("new").alias("n"))
    per = per.select("b", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("base"))
    grouped = seen.join(per, "b").withColumn("g", F.col("base") + F.sum(F.col("new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    least = grouped.groupBy("g").agg(F.min("at").alias("least"))
    return grouped.join(least, "g").where("at > least").select("doc_id", "start")
