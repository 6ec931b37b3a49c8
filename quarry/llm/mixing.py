"""Mixing sources to target weights: budgets flow down a domain, language, source tree, and each leaf
gives the prefix of its seeded epochs that fills its budget."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import words_of

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that form the blocks of the two-level running sums.
BLOCK_DIGITS = 3


@dataclass(frozen=True)
class Targets:
    """Weights are whole numbers; a name that is not listed weighs 1. The budget is this share of all tokens."""

    domains: Mapping[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    sources: Mapping[str, int] = field(default_factory=dict)
    budget_percent: int = 50
    max_epochs: int = 2
    seed: int = 7


def domain_of(source: Column) -> Column:
    """The domain of a source: the number in its name, modulo 4; other for names without one."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(n != "", F.concat(F.lit("d"), (n.cast("long") % 4).cast("string"))).otherwise(F.lit("other"))


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    chosen = F.lit(1)
    for k, w in sorted(weights.items()):
        chosen = F.when(F.col(name) == k, F.lit(w)).otherwise(chosen)
    return chosen.cast("decimal(38,0)")


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `given`: the parent's `budget` shared by `weight` among its children, none above its `capacity`.
    What a child can't take goes to its siblings by their weights. Children in order of capacity / weight: while
    the next one's capacity is within its share of what is left it gets all, the others split the rest; units
    left by rounding go to the first of these."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("capacity") / F.col("weight")).cast("double"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumn("left", F.col("budget") - F.coalesce(_whole(F.sum("capacity").over(before)), _whole(F.lit(0))))
    c = c.withColumn("weights", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    c = c.withColumn("full", F.col("capacity") * F.col("weights") <= F.col("weight") * F.col("left"))
    c = c.withColumn("full", F.min(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    split = ~F.col("full")
    c = c.withColumn("rest", F.max(F.when(split, F.col("left"))).over(by)).withColumn("rest_weights", F.max(F.when(split, F.col("weights"))).over(by))
    part = _whole(F.floor(F.col("weight") * F.col("rest") / F.col("rest_weights")))
    part = part - F.when(part * F.col("rest_weights") > F.col("weight") * F.col("rest"), 1).otherwise(0)
    c = c.withColumn("given", _whole(F.when(F.col("full"), F.col("capacity")).otherwise(part)))
    c = c.withColumn("units", F.col("budget") - F.sum("given").over(by)).withColumn("nth", F.sum(split.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.when(split & (F.col("nth") <= F.col("units")), F.lit(1)).otherwise(F.lit(0))
    return c.withColumn("given", _whole(F.col("given") + extra)).drop("left", "weights", "full", "rest", "rest_weights", "units", "nth")


def leaf_budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """domain, lang, source, tokens -> leaf_budget. A subtree's capacity is its tokens in max_epochs epochs; as a
    parent's share is already within its children's capacity, shortages stay among siblings as far as these
    can take them, and only then move to the siblings of an ancestor."""
    weights = (targets.domains, targets.langs, targets.sources)
    node = leaves.withColumn("capacity", _whole(F.col("tokens") * targets.max_epochs))
    root = node.agg(F.least(_whole(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * targets.budget_percent / 100)), _whole(F.sum("capacity"))).alias("budget"))
    for depth, name in enumerate(LEVELS):
        parent, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        level = node.groupBy(*path).agg(_whole(F.sum("capacity")).alias("capacity")).withColumn("weight", _weight(name, weights[depth]))
        level = level.join(root, parent) if parent else level.crossJoin(F.broadcast(root))
        root = share_out(level, parent, name).select(*path, F.col("given").alias("budget"))
    return leaves.join(root, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").cast("long").alias("leaf_budget"))


def plan(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:  # noqa: B008
    """Adds domain, n_tokens (words), order_key and, from its leaf, leaf_budget, full_epochs, cut_key, cut_tokens to
    each row. A row is used in every full epoch, and once more in the next epoch if its order_key is at most cut_key.
    Of rows at cut_key itself, cut_tokens tokens are still wanted.

    Null lang or source count as the name (none); a null or empty text has no tokens; rows that repeat a doc_id share
    its key and each count their tokens; a leaf without tokens has no budget; an empty table gives no rows."""
    named = docs.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("(none)")) for n in ("lang", "source")})
    named = named.withColumn("domain", domain_of(F.col("source"))).withColumn("n_tokens", F.size(words_of(F.col("text").cast("string"))).cast("long"))
    leaf = list(LEVELS)
    small = named.select(*leaf, "doc_id", "n_tokens")
    budgets = leaf_budgets(small.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), targets)
    budgets = budgets.withColumn("full_epochs", F.when(F.col("tokens") > 0, F.floor(F.col("leaf_budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    budgets = budgets.withColumn("wanted", F.col("leaf_budget") - F.col("full_epochs") * F.col("tokens"))

    # the leaf's position in its next epoch: first the block of keys where the wanted tokens end, then the key
    key = F.md5(F.concat_ws(":", F.lit(targets.seed), F.col("full_epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = small.join(budgets.select(*leaf, "full_epochs", "wanted"), leaf).withColumn("order_key", key).withColumn("block", F.substring("order_key", 1, BLOCK_DIGITS))
    blocks = keyed.groupBy(*leaf, "block").agg(F.sum("n_tokens").alias("t"), F.first("wanted").alias("wanted"))
    running = Window.partitionBy(*leaf).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(running), F.lit(0)))
    blocks = blocks.where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("t") >= F.col("wanted"))).select(*leaf, "block", "before")
    at_end = keyed.join(blocks, [*leaf, "block"]).groupBy(*leaf, "block", "order_key", "before", "wanted").agg(F.sum("n_tokens").alias("t"))
    inside = Window.partitionBy(*leaf, "block").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    at_end = at_end.withColumn("start", F.col("before") + F.coalesce(F.sum("t").over(inside), F.lit(0)))
    cuts = at_end.where((F.col("start") < F.col("wanted")) & (F.col("start") + F.col("t") >= F.col("wanted")))
    cuts = cuts.select(*leaf, F.col("order_key").alias("cut_key"), (F.col("wanted") - F.col("start")).alias("cut_tokens"))
    of_leaf = budgets.join(cuts, leaf, "left").select(*leaf, "leaf_budget", "full_epochs", "cut_key", "cut_tokens")
    return named.join(of_leaf, leaf).withColumn("order_key", key)


def mix(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:  # noqa: B008
    """doc_id, domain, lang, source, n_tokens, leaf_budget, copies (epochs that use the row, the last perhaps in part)
    and tokens_taken for every row. Rows with the same doc_id in the leaf stand at one place of an epoch; at the cut
    each of them takes at most the tokens that are still wanted there."""
    p = plan(docs.select("doc_id", "text", "lang", "source"), targets)
    last = F.coalesce(F.when(F.col("order_key") < F.col("cut_key"), F.col("n_tokens")).when(F.col("order_key") == F.col("cut_key"), F.least("n_tokens", "cut_tokens")), F.lit(0))
    used = F.coalesce((F.col("order_key") <= F.col("cut_key")).cast("int"), F.lit(0))
    return p.select(
        "doc_id", *LEVELS, "n_tokens", "leaf_budget",
        (F.col("full_epochs") + used).cast("long").alias("copies"),
        (F.col("full_epochs") * F.col("n_tokens") + last).cast("long").alias("tokens_taken"),
    )


def chosen(docs: DataFrame, targets: Targets) -> DataFrame:
    """The rows of docs, whole and with their own columns, that at least one epoch uses. Rows that repeat an id each have a place of
    their own; null texts have no tokens; very long texts are counted whole; an empty table gives no rows."""
    marked = docs.withColumn("row_", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    p = plan(marked.select("doc_id", "text", "lang", "source", "row_"), targets)
    return p.where((F.col("full_epochs") > 0) | (F.col("order_key") <= F.col("cut_key"))).select("row_.*")
