"""Connected components of a table of links, without collecting it, and the buckets that could still join some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.scratch import written as materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> id, component (the least id reachable). No links, no rows.

    Each round every id goes to its neighbour that comes first in the round's random order, or stays if it does so itself; then
    the links are put between the places that are left, and those within one place go. A round halves a chain and folds up a
    star, so the rounds grow with the logarithm of the ids and the rows of all rounds together with the links. The rounds'
    moves, fewer each time, are then followed from the last to the first."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    n = edges.count()
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        if len(moves) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        order = lambda c: F.xxhash64(F.lit(len(moves)), c)
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min_by("b", F.struct(order("b").alias("h"), "b")).alias("b"))
        stays = F.struct(order("a").alias("h"), F.col("a").alias("x")) <= F.struct(order("b").alias("h"), F.col("b").alias("x"))
        moved = materialize(first.select(F.col("a").alias("id"), F.when(stays, F.col("a")).otherwise(F.col("b")).alias("up")), "moves", 2 * n)
        moves.append(moved)
        # each link has a row from either end; together these tell where both ends went
        ends = materialize(both.join(moved.withColumnRenamed("id", "a"), "a"), "ends", 2 * n)
        gone = ends.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("up").alias("a"), F.max("up").alias("b"))
        edges = materialize(gone.where("a <> b").select("a", "b"), "links", n)
    if not moves:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    final = moves[-1].withColumnRenamed("up", "root")
    for moved in reversed(moves[:-1]):
        joined = moved.join(final.withColumnRenamed("id", "up"), "up", "left").select("id", F.coalesce("root", "up").alias("root"))
        final = materialize(joined, "roots", 2 * n)
    least = materialize(final.groupBy("root").agg(F.min("id").alias("component")), "components", 2 * n)
    return materialize(final.join(least, "root").select("id", "component"), "labels", 2 * n)


def apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """members (id, bucket) with component and top, only of buckets in which more than one component is left; top is the
    component with most members there. label: id, component; an id that it lacks is its own component."""
    own = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    top = parts.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    return own.join(top, "bucket")
