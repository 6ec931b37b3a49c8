"""Incremental ingest: change detection, upserts where the newest wins, counters, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(listing: DataFrame, state: DataFrame) -> DataFrame:
    """key, status (new, modified, unchanged, deleted) from two tables of key, hash."""
    both = listing.select("key", F.col("hash").alias("now")).join(state.select("key", F.col("hash").alias("then")), "key", "full")
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("modified")
    return both.select("key", status.alias("status"))


def newest_wins(stored: DataFrame, incoming: DataFrame, key: str, updated: str, pos: str, fixed: Sequence[str]) -> DataFrame:
    """Stored rows after the incoming ones, in the order of `pos`, have each replaced the row of their key if they are
    strictly newer; rows without a date never replace, a stored row without one gives way to any with one. The
    `fixed` columns keep the first row's values. One shuffle by key over both tables."""
    every = stored.withColumn("pos_", F.lit(-1).cast("long")).unionByName(incoming.withColumn("pos_", F.col(pos).cast("long")).drop(pos))
    rest = [c for c in stored.columns if c not in (key, *fixed)]
    first = F.min_by(F.struct(*[F.col(c) for c in (*fixed, *rest)]), F.col("pos_"))
    # the greatest date, and of equal dates the earliest row
    dated = F.max_by(F.struct(*[F.col(c) for c in rest]), F.when(F.col(updated).isNotNull(), F.struct(F.col(updated), -F.col("pos_"))))
    g = every.groupBy(key).agg(first.alias("f_"), dated.alias("d_"))
    return g.select(key, *[F.col(f"f_.{c}").alias(c) for c in fixed], *[F.coalesce(F.col(f"d_.{c}"), F.when(F.col("d_").isNull(), F.col(f"f_.{c}"))).alias(c) for c in rest])


def counters(stored: DataFrame, incoming: DataFrame, key: str, updated: str, pos: str) -> DataFrame:
    """What each incoming row did, in file order: status inserted, updated or skipped, and the number of such rows."""
    every = stored.select(key, updated, F.lit(-1).cast("long").alias("pos_")).unionByName(incoming.select(key, updated, F.col(pos).cast("long").alias("pos_")))
    w = Window.partitionBy(key).orderBy("pos_").rowsBetween(Window.unboundedPreceding, -1)
    before, seen = F.max(updated).over(w), F.count(F.lit(1)).over(w)
    newer = F.col(updated).isNotNull() & (before.isNull() | (F.col(updated) > before))
    status = F.when(seen == 0, "inserted").when(newer, "updated").otherwise("skipped")
    return every.withColumn("status", status).where("pos_ >= 0").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def snapshot(versions: DataFrame, version: int) -> DataFrame:
    """The rows of id, version, deleted as of a version: the latest of each id, without tombstones."""
    w = Window.partitionBy("id").orderBy(F.desc("version"))
    return versions.where(F.col("version") <= version).withColumn("r_", F.row_number().over(w)).where("r_ = 1 and not deleted").drop("r_")
