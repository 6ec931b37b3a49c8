"""SimHash fingerprints: hashed word shingles vote on signed bits, and permuted block tables find near ones.
DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, words_of
from quarry.operators.components import apart, components

BITS = 128
SHINGLE = 5
#: Fingerprints at most this many bits apart count as near; the mean distance at a shingle Jaccard of 0.96.
RADIUS = 8
#: Blocks of a fingerprint; at least BLOCKS - RADIUS of them are equal in near ones. A table's key holds so many blocks, so
#: more blocks make more tables (their choices) with longer keys: 10 give 45 of 25 bits, 12 give 495 of 42.
BLOCKS = 10
#: Tables' buckets of up to so many fingerprints are compared pair by pair at once; larger ones through a hub first.
SMALL = 8
#: Quantiles of doc_id, and equal steps between two of them, that make the ranges in which neighbours are looked up.
QUANTILES, STEPS = 64, 64


def range_of(docs: DataFrame) -> Column:
    """The number of the range of a doc_id; it rises with the id, so null and the least ids have the lowest."""
    x = F.col("doc_id").cast("double")
    marks = docs.agg(F.percentile_approx(x, [k / QUANTILES for k in range(QUANTILES + 1)], 10_000)).first()[0] or [0.0]
    marks = sorted(set(marks))  # QUANTILES + 1 numbers at most
    bounds = F.array(*[F.lit(m) for m in marks])
    k = F.greatest(F.size(F.filter(bounds, lambda m: m <= x)), F.lit(1))
    low = F.element_at(bounds, k)
    width = F.greatest(F.coalesce(F.element_at(F.array(*[F.lit(m) for m in [*marks[1:], marks[-1] + 1]]), k) - low, F.lit(1.0)), F.lit(1e-9))
    step = F.greatest(F.least(F.floor((x - low) / width * STEPS), F.lit(STEPS - 1)), F.lit(0))
    return F.when(x.isNull(), F.lit(-1)).otherwise(k * STEPS + step).cast("long")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs with own (the text's hash), range, nth and next_text, the text of the row that follows in
    descending doc_id, after the last the first. range and nth number the rows, whatever task computes them.

    Rows are dealt out by ranges of doc_id between quantiles, so that gaps and outliers don't fill one range. Inside a
    range the next row is found by order, of ids that repeat by the texts' hashes; a range's last row takes the first
    row of the next range that has rows. Only ids and hashes of these first rows go to one place, then their texts
    are looked up; there is one for each range."""
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("own"), range_of(docs).alias("range"))
    first = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "own")).alias("m")).select("range", F.col("m.doc_id").alias("f_id"), F.col("m.own").alias("f_own"))
    first = materialize(first, "firsts")
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = lambda c: F.coalesce(F.lead(c).over(down), F.first(c).over(whole)).alias(c)
    edges = first.select(F.col("range").alias("e_range"), follows("range"))
    texts = ranged.join(first, "range").where(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("own") == F.col("f_own"))).groupBy("range").agg(F.first("text").alias("edge_text"))
    edges = edges.join(texts, "range").select(F.col("e_range").alias("range"), "edge_text")
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("own").desc())
    rows = ranged.withColumn("inside_text", F.lead("text").over(inside)).withColumn("nth", F.row_number().over(inside)).withColumn("is_last", F.lead(F.lit(True)).over(inside).isNull())
    return rows.join(edges, "range").withColumn("next_text", F.when(F.col("is_last"), F.col("edge_text")).otherwise(F.col("inside_text"))).drop("inside_text", "is_last", "edge_text")


def shingle_rows(words: str) -> Column:
    """One struct for each run of SHINGLE words of a column; a text of 1 to 4 words gives one of them all, the rest null."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.least(F.size(words), F.lit(1)))
    return F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(SHINGLE)])


def votes(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """For each group the sums from which its fingerprint is read: of each bit, the shingles that have it set.

    Two hashes of 64 bits give BITS bits. A sum holds the counts of the bits i and i + 32 of a hash, in its lower and
    upper half, so that 2 * 32 sums do; a shingle that occurs often votes as often."""
    words = [f"w{k}" for k in range(SHINGLE)]
    hashed = rows.select(*by, *keep, F.col("w0").isNotNull().alias("there"), F.xxhash64(*words).alias("h0"), F.xxhash64(F.lit(7), *words).alias("h1"))
    lanes = F.lit((1 << 32) + 1)
    bit = lambda h, i: F.shiftrightunsigned(h, i).bitwiseAND(lanes)
    sums = [F.sum(F.when(F.col("there"), bit(F.col(h), i))).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(32)]
    return hashed.groupBy(*by).agg(F.count_if("there").alias("n"), *[F.first(k).alias(k) for k in keep], *sums)


def fingerprint_halves() -> list[Column]:
    """The two halves of the fingerprint from the sums: a bit is set if more than half of the shingles set it."""
    out = []
    for h in ("h0", "h1"):
        parts = []
        for i in range(32):
            s = F.col(f"{h}_{i}")
            parts.append(F.when(2 * s.bitwiseAND(F.lit((1 << 32) - 1)) > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)))
            parts.append(F.when(2 * F.shiftrightunsigned(s, 32) > F.col("n"), F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0))).otherwise(F.lit(0)))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.bitwiseOR(p)
        out.append(F.coalesce(whole.cast("long"), F.lit(0).cast("long")))
    return out


def fingerprint(high: Column, low: Column) -> Column:
    """32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """The cosine that the share of differing bits stands for, 0 where it is negative, 1 for equal fingerprints."""
    apart = F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))
    return F.greatest(F.cos(apart / BITS * 3.141592653589793), F.lit(0.0))


def table_keys(high: Column, low: Column, blocks: int, radius: int) -> Column:
    """The keys of a fingerprint in all tables: a table for each choice of blocks - radius blocks, keyed by these.
    Half of the blocks are in either half of the fingerprint."""
    edge = [round(k * 64 / (blocks // 2)) for k in range(blocks // 2 + 1)]
    parts = [F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for h in (high, low) for a, b in zip(edge, edge[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(t), *[parts[k] for k in chosen]) for t, chosen in enumerate(combinations(range(len(parts)), len(parts) - radius))])


def distance(a: str = "a", b: str = "b") -> Column:
    """Bits in which the fingerprints high_a, low_a and high_b, low_b differ."""
    return F.bit_count(F.col(f"high_{a}").bitwiseXOR(F.col(f"high_{b}"))) + F.bit_count(F.col(f"low_{a}").bitwiseXOR(F.col(f"low_{b}")))


def in_tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """id, high, low, bucket, size: the fingerprints (id, high, low) in the tables' buckets of more than one."""
    if blocks % 2 or not radius < blocks:
        raise ValueError("an even number of blocks above the radius is needed")
    keyed = prints.select("high", "low", F.explode(table_keys(F.col("high"), F.col("low"), blocks, radius)).alias("bucket"))
    size = materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    return keyed.join(size, "bucket").join(prints, ["high", "low"])


def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("bucket", *[F.col(c).alias(f"{c}_{name}") for c in ("id", "high", "low", *more)])


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (id_a, id_b), each once, of the fingerprints (id, high, low; ids differ) at most `radius` bits apart. Near ones
    agree in at least blocks - radius blocks, so they meet in some table. Distances are part of the join, so that only
    near pairs leave it; a group of fingerprints that are all near has as many pairs as that. near_classes() has not."""
    held = in_tables(prints, radius, blocks)
    near = (F.col("id_a") < F.col("id_b")) & (distance() <= radius)
    return side(held, "a").join(side(held, "b"), "bucket").where(near).select("id_a", "id_b").distinct()


def near_classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """id, component of the fingerprints (id, high, low) that are connected over steps of at most `radius` bits, exactly;
    those that are alone are left out. In buckets of up to SMALL all pairs are looked at, in larger ones each with a hub, and
    then those that are still outside the bucket's largest component with all others there."""
    held = materialize(in_tables(prints, radius, blocks), "buckets")
    few, large = held.where(F.col("size") <= SMALL), held.where(F.col("size") > SMALL)
    near = distance() <= radius
    found = side(few, "a").join(side(few, "b"), "bucket").where((F.col("id_a") < F.col("id_b")) & near).select("id_a", "id_b")
    hub = large.groupBy("bucket").agg(F.min(F.struct("id", "high", "low")).alias("m")).select("bucket", *[F.col(f"m.{c}").alias(f"{c}_b") for c in ("id", "high", "low")])
    star = side(large, "a").join(hub, "bucket").where((F.col("id_a") != F.col("id_b")) & near).select("id_a", "id_b")
    links = materialize(found.unionByName(star).toDF("a", "b").distinct(), "near")
    label = components(links)
    left = materialize(apart(large, label), "left")
    if left.isEmpty():
        return label
    x, y = side(left.where("component <> top"), "a", "component"), side(left, "b", "component", "top")
    other = F.expr("component_a <> component_b and (component_b = top_b or id_a < id_b)")
    more = materialize(x.join(y, "bucket").where(other & near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "near")
    return label if more.isEmpty() else components(links.unionByName(more))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, n_same, n_class of each row.

    The edited text has its last third replaced from the start of the next row's text. near_edited and near_next are
    likenesses (0 to 1) of the fingerprint to those of the edited and of the next text. Rows whose fingerprints are
    connected over steps of at most RADIUS bits are a class: class_id is its least doc_id (null if none has one) and
    n_class its number of rows; n_same is the number of other rows with the same fingerprint. A null text is empty; a
    text without words has the fingerprint 0; very long texts are taken whole; rows that repeat a doc_id follow each other
    in order of their texts' hashes; null doc_ids come last; one row alone is its own next; other columns are left out;
    an empty table gives no rows."""
    rows = neighbours(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    row = ["range", "nth", "is_edited"]
    rows = rows.select("range", "nth", "doc_id", "own", F.xxhash64("next_text").alias("next"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # the digest goes along as numbers of 60 bits, so that the sums stay in a hash table
    digits = [F.conv(F.substring(F.sha2("t", 256), at, 15), 16, 10).cast("long") for at in range(1, 65, 15)]
    sha = [f"sha{k}" for k in range(len(digits))]
    texts = F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("t")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("t")))
    keep = ["doc_id", "own", "next", "n_chars"]
    both = rows.select("range", "nth", *keep, F.inline(texts).alias("is_edited", "t"))
    both = both.select(*row, *keep, *[d.alias(c) for c, d in zip(sha, digits, strict=True)], words_of(F.col("t")).alias("words"))
    exploded = both.select(*row, *keep, *sha, F.inline_outer(shingle_rows("words")).alias(*[f"w{k}" for k in range(SHINGLE)]))
    summed = votes(exploded, row, [*keep, *sha])
    high, low = fingerprint_halves()
    marks = materialize(summed.select(*row, *keep, *sha, high.alias("high"), low.alias("low")), "fingerprints")

    own = marks.where("not is_edited").select("range", "nth", *keep, "high", "low")
    edited_sha = F.lower(F.concat(*[F.lpad(F.hex(c), 15 if k < len(sha) - 1 else 64 % 15, "0") for k, c in enumerate(sha)]))
    changed = marks.where("is_edited").select("range", "nth", edited_sha.alias("edited_sha256"), F.col("high").alias("e_high"), F.col("low").alias("e_low"))
    of_text = own.groupBy(F.col("own").alias("next")).agg(F.first("high").alias("n_high"), F.first("low").alias("n_low"))
    same = own.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    same = materialize(same.withColumn("id", fingerprint(F.col("high"), F.col("low"))), "same")
    named = same.join(near_classes(same.select("id", "high", "low")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_class = named.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("rows").alias("n_class"))
    of_print = named.join(of_class, "component").select("high", "low", "class_id", (F.col("rows") - 1).alias("n_same"), "n_class")
    done = own.join(changed, ["range", "nth"]).join(of_text, "next", "left").join(of_print, ["high", "low"])
    h, l = F.col("high"), F.col("low")  # noqa: E741
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(h, l).alias("fingerprint"),
        fingerprint(F.col("e_high"), F.col("e_low")).alias("edited_fingerprint"),
        likeness([h, l], [F.col("e_high"), F.col("e_low")]).alias("near_edited"),
        likeness([h, l], [F.col("n_high"), F.col("n_low")]).alias("near_next"),
        "class_id", "n_same", "n_class",
    )
