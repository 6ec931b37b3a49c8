"""MinHash near-duplicates of word shingles as multisets: BagMinHash signatures, bands, exact overlap, classes.

Texts are known by the digest of their words (id), so rows that share a doc_id or have none are told apart."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import GOLDEN as _G
from quarry.llm.common import MEMORIES, Hashes, id_key, materialize, mix, released, text_key, zipped
from quarry.operators.components import apart, components

SHINGLE = 5
SIMILAR = 0.8
#: A pair of weighted Jaccard 0.8 shares no band with probability (1 - 0.8**4)**32 < 1e-7.
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Buckets of up to so many texts are compared pair by pair at once; larger ones through hubs first, see classes().
SMALL = 8
#: Turns in which texts that are still apart meet another hub, before all pairs that are left.
TURNS = 2
#: Texts, and shingles in them, of one block of a large group, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 60_000
#: Shingles whose processes run side by side in a task.
BLOCK = 200_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_hashes = Hashes()
MEMORIES["minhash"] = _hashes.clear


def words_of(text: str | None) -> list[str]:
    return _WORDS(text or "")


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the runs of SHINGLE words, repeated as often as they occur; a shorter text is one shingle, no words none."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - SHINGLE + 1, min(len(h), 1))
    if not n:
        return h
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = mix(out * _G + h[k : k + n])
    return out


def numbered(bag: np.ndarray) -> frozenset[int]:
    """A multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    bag = np.sort(bag)
    first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]])) if len(bag) else np.zeros(0, np.int64)
    nth = np.arange(len(bag)) - np.repeat(first, np.diff(np.concatenate([first, [len(bag)]])))
    return frozenset((mix(bag + nth.astype(np.uint64) * _G) if nth.any() else mix(bag)).tolist())


def alike(a: frozenset[int], b: frozenset[int]) -> float:
    """Weighted Jaccard similarity of two numbered() multisets; 1 if both are empty."""
    both = len(a & b)
    return both / max(len(a) + len(b) - both, 1) if a or b else 1.0


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    return alike(numbered(a), numbered(b))


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """BagMinHash signatures, one row of SLOTS values a bag.

    The weight axis is cut at 1, 2, 4, 8, ...: each shingle has a Poisson process on each of these cells, whose rate
    is the cell's length, and each of its points has a slot and a level in the cell. A bag sees the points whose
    level is under the shingle's count in it, so bags share a point just where both weights reach it. A slot's
    value is its earliest point. A process stops when its time is past the latest slot of its bag."""
    sizes = [np.unique(b, return_counts=True) for b in bags]
    bag = np.repeat(np.arange(len(bags)), [len(k) for k, _ in sizes])
    key = np.concatenate([k for k, _ in sizes]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in sizes]) if bags else np.zeros(0, np.int64)
    parts = [(bag, mix(key), np.zeros(len(bag)), np.ones(len(bag)), weight)]
    low = 1
    while (more := weight > low).any():
        parts.append((bag[more], mix(key[more] + np.uint64(low * int(_G) % 2**64)), np.full(more.sum(), float(low)), np.full(more.sum(), float(low)), weight[more]))
        low *= 2
    bag, state, start, length, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    times = np.full(len(bags) * SLOTS, np.inf)
    when = np.zeros(len(bag))
    while len(bag):
        state = state + _G
        a = mix(state)
        b = mix(a ^ _G)
        when = when - np.log(((a >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / length
        level = start + (b >> np.uint64(32)).astype(float) * 2.0**-32 * length
        seen = level < weight
        slot = (b & np.uint64(SLOTS - 1)).astype(np.int64)
        np.minimum.at(times, (bag * SLOTS + slot)[seen], when[seen])
        own, at = np.unique(bag, return_inverse=True) if len(bag) < 4 * len(bags) else (np.arange(len(bags)), bag)
        latest = times.reshape(-1, SLOTS)[own].max(1)
        go = when < latest[at]
        bag, state, start, length, weight, when = bag[go], state[go], start[go], length[go], weight[go], when[go]
    return times.reshape(-1, SLOTS)


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature. Times are rounded, so that the last digits of a logarithm don't matter."""
    v = signature.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * _G + v[:, :, k])
    return h.view(np.int64)


def marks(signature: np.ndarray) -> np.ndarray:
    """A byte for each slot of each signature, eight in a number."""
    return (mix(signature.astype(np.float32).view(np.uint32).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, id (digest of the words), n (shingles), bands, marks of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, at = b["text"].tolist(), 0
            while at < len(texts):
                bags, ids, start, total = [], [], at, 0
                while at < len(texts) and total < BLOCK:
                    words = words_of(texts[at])
                    bags.append(shingles(words))
                    ids.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
                    total, at = total + len(bags[-1]), at + 1
                own, rows = signatures(bags), b.iloc[start:at]
                yield pd.DataFrame({"doc_id": rows["doc_id"].array, "text_key": rows["text_key"].array, "id": ids, "n": [len(x) for x in bags], "bands": list(bands(own)), "marks": list(marks(own))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(released(run, "minhash"), f"doc_id {kind}, text_key binary, id binary, n bigint, bands array<bigint>, marks array<bigint>")


def bag_of(packed: bytes) -> frozenset[int]:
    """numbered() shingles of a zipped text."""
    return numbered(shingles(words_of(zstandard.ZstdDecompressor().decompress(packed).decode("utf-8"))))


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts (id, text: zipped) overlap by at least `least`."""
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, bag = None, frozenset()
        for b in batches:
            found = []
            for x, y in zip(b["text_a"], b["text_b"], strict=True):
                if hub is None or y != hub:
                    hub, bag = y, bag_of(y)
                found.append(alike(bag_of(x), bag) >= least)
            yield b.loc[found, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(released(run, "minhash"), "a binary, b binary")


def buckets(distinct: DataFrame) -> DataFrame:
    """id, bucket, size: the buckets of more than one text (id, bands)."""
    one = distinct.select("id", F.explode("bands").alias("bucket"))
    size = one.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return one.join(size, "bucket").select("id", "bucket", "size")


def candidates(one: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of a bucket of up to SMALL texts; in a larger one each text with the most central one, that
    with the most companions over its large buckets. Their number grows with the texts."""
    few = one.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pair = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    large = one.where(F.col("size") > SMALL)
    central = large.groupBy("id").agg(F.sum("size").alias("central"))
    hub = large.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("central", "id")).alias("hub"))
    star = large.join(hub, "bucket").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return few.select(F.inline(pair)).unionByName(star).distinct()


def equal_slots(x: str, y: str):
    """The number of equal bytes of two columns of marks."""

    def equal(k: int):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        # a byte's lowest bit is set where any of its bits is
        for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, by).bitwiseAND(F.lit(mask)))
        return F.lit(8) - F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    return sum((equal(k) for k in range(1, SLOTS // 8)), equal(0))


def possible(least: float):
    """Whether texts x and y (n_x, m_x, n_y, m_y) may overlap by `least`: not if their numbers of shingles differ too much for
    it (exact), nor if their signatures have fewer equal slots than such a pair has, by 7 standard deviations
    (probability < 1e-8)."""
    sizes = F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y") - 1e-6
    return sizes & (equal_slots("m_x", "m_y") >= least_slots(least))


def least_slots(least: float) -> int:
    return int(SLOTS * least - 7 * (SLOTS * least * (1 - least)) ** 0.5)


def plausible(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """The pairs that possible() doesn't rule out."""
    x, y = (distinct.select(F.col("id").alias(z), F.col("n").alias(f"n_{s}"), F.col("marks").alias(f"m_{s}")) for z, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(possible(least)).select("a", "b")


def stars(left: DataFrame, turn: int) -> DataFrame:
    """(a, b): each text outside its bucket's largest component with one text of that component, another one each turn."""
    hub = left.where("component = top").groupBy("bucket").agg(F.max_by("id", F.xxhash64(F.lit(turn), "id")).alias("hub"))
    return left.where("component <> top").join(hub, "bucket").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def across(left: DataFrame, distinct: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): the links between texts of different components that are connected over large buckets.

    Each text outside the largest component of such a group meets all texts of the group's other components. The texts of
    a group are dealt into blocks of about BLOCK_TEXTS texts or BLOCK_SHINGLES shingles; a task gets a block of the ones
    and a block of the others. First only their signatures meet; then those that may be alike to some other one of their cell
    get their texts, whose whole shingles are compared. Only links leave it."""
    hub = left.groupBy("bucket").agg(F.min("id").alias("b"))
    # a text joins the hubs of its buckets; few hubs stand for many buckets, so each text goes to its least one, and hubs to that
    met = left.join(hub, "bucket").groupBy("id").agg(F.min("b").alias("b"), F.collect_set("b").alias("hubs"))
    group = components(met.select(F.explode(F.array_append("hubs", F.col("id"))).alias("a"), "b").distinct())
    own = left.select("id", "component").distinct().join(group.select("id", F.col("component").alias("group")), "id")
    parts = own.groupBy("group", "component").agg(F.count(F.lit(1)).alias("k"))
    top = parts.groupBy("group").agg(F.max_by("component", F.struct("k", "component")).alias("top"))
    own = materialize(own.join(top, "group").join(distinct.select("id", "n", "marks"), "id").withColumn("lone", F.col("component") != F.col("top")), "apart")
    need = lambda count, size: F.greatest(F.ceil(count / BLOCK_TEXTS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    size = own.groupBy("group").agg(need(F.count_if("lone"), F.sum(F.when(F.col("lone"), F.col("n")))).alias("nx"), need(F.count(F.lit(1)), F.sum("n")).alias("ny"))
    own = own.join(size, "group").withColumn("block", F.abs(F.hash("id")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = ["id", "component", "top", "n", "marks"]
    x = own.where("lone").select("group", (F.col("block") % F.col("nx")).alias("bx"), every("ny").alias("by"), F.lit(True).alias("is_x"), *cells)
    y = own.select("group", every("nx").alias("bx"), (F.col("block") % F.col("ny")).alias("by"), F.lit(False).alias("is_x"), *cells)

    def pairs_of(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """The place of each row of a with the places in b that it may be alike to, of another component."""
        bytes_of = lambda r: np.stack(r["marks"].to_list()).astype(np.int64).view(np.uint8)
        m, n, ids, of = bytes_of(b), b["n"].to_numpy(), b["id"].to_numpy(object), b["component"].to_numpy(object)
        for at, (x_id, c, top_, n_x, own_) in enumerate(zip(a["id"], a["component"], a["top"], a["n"], bytes_of(a), strict=True)):
            may = (np.minimum(n, n_x) >= least * np.maximum(n, n_x) - 1e-6) & ((m == own_).sum(1) >= least_slots(least))
            yield at, np.array([k for k in np.flatnonzero(may) if of[k] != c and (of[k] == top_ or x_id < ids[k])], int)

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["is_x"]], rows[~rows["is_x"]]
        keep_a, keep_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        if len(a) and len(b):
            for at, others in pairs_of(a, b):
                keep_a[at] = len(others) > 0
                keep_b[others] = True
        return pd.concat([a[keep_a], b[keep_b]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["is_x"]], rows[~rows["is_x"]]
        found, bags, above = [], {}, {}

        def root(c):
            while c in above:
                c = above[c]
            return c

        if len(a) and len(b):
            ids, of, texts_of, own_texts = b["id"].to_list(), b["component"].to_list(), b["text"].to_list(), a["text"].to_list()
            own_ids, own_of = a["id"].to_list(), a["component"].to_list()
            for at, others in pairs_of(a, b):
                bag, c, x_id = None, own_of[at], own_ids[at]
                for k in others:
                    if root(of[k]) == root(c):
                        continue
                    bag = bag_of(own_texts[at]) if bag is None else bag
                    if k not in bags:
                        bags[k] = bag_of(texts_of[k])
                    if alike(bag, bags[k]) >= least:
                        above[root(c)] = root(of[k])
                        found.append((min(x_id, ids[k]), max(x_id, ids[k])))
        return pd.DataFrame(found, columns=["a", "b"])

    met = x.unionByName(y)
    some = materialize(met.groupBy("group", "bx", "by").applyInPandas(near, met.schema), "near")
    return some.join(texts, "id").groupBy("group", "bx", "by").applyInPandas(run, "a binary, b binary")


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) after more links (a, b): only the components that these join are looked at."""
    of = lambda side: label.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = components(pairs.distinct())
    moved = label.join(up.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    more = up.join(label, "id", "left_anti").select("id", "component")
    return materialize(moved.unionByName(more), "labels")


def labelled(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, text_key, id, n, component of each row, where component is the id of the class.

    Signatures find the texts that share a band. Those of small buckets, and in large ones each with a hub, have their
    whole texts compared. Texts of a large bucket that are still in different components meet other hubs in TURNS turns, and
    then all texts of the other components (see across()). So no pair that shares a band is left uncompared but for those
    in one component, and the comparisons grow with the square only of texts that share bands and are not alike."""
    signed = materialize(sign(docs), "signatures")
    first = F.min_by(F.struct("text_key", "n", "bands", "marks"), "text_key")
    distinct = materialize(signed.groupBy("id").agg(first.alias("m")).select("id", "m.*"), "distinct")
    worded = distinct.where("n > 0")
    one = materialize(buckets(worded), "buckets")
    n = one.count()  # links with hubs and within small buckets are at most SMALL times as many
    some = distinct.join(one.select("id").distinct(), "id", "left_semi").select("id", "text_key")
    texts = docs.select(text_key(F.col("text")).alias("text_key"), zipped(F.col("text").cast("string")).alias("text"))
    texts = materialize(texts.join(some, "text_key").dropDuplicates(["text_key"]).select("id", "text"), "texts")

    done = materialize(plausible(candidates(one), worded, least), "pairs", n)
    label = components(materialize(verify(done, texts, least), "found"))
    for turn in range(TURNS + 1):
        left = materialize(apart(one.where(F.col("size") > SMALL).select("id", "bucket"), label), "left", n)
        if left.isEmpty():
            break
        if turn < TURNS:
            asked = materialize(plausible(stars(left, turn), worded, least).join(done, ["a", "b"], "left_anti"), "pairs", n)
            more, done = verify(asked, texts, least), done.unionByName(asked)
        else:
            more = across(left, worded, texts, least)
        more = materialize(more, "found")
        if more.isEmpty():
            continue
        label = joined(label, more)
    final = distinct.select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return signed.select("doc_id", "text_key", "id", "n").join(final, "id")


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class; null if none has one), n_shingles of each row.

    Two texts are linked if their multisets of 5-word shingles overlap by at least `least`, or if their words are the
    same; classes are the connected groups. Texts of 1 to 4 words are one shingle; texts without words (null and empty
    ones too) are one class; very long texts are compared whole. Rows that repeat a doc_id, with the same or with another
    text, and rows with a null doc_id give a row each; other columns are left out; an empty table gives no rows."""
    rows = materialize(labelled(docs, least), "labelled")
    of = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return rows.join(of, "component").select("doc_id", "class_id", F.col("n").alias("n_shingles"))


def dedup(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of docs, with its own columns, for each class of classes(): that of the least doc_id (null last), of rows
    with the same doc_id that of the least digest of its text, of rows that repeat both any one. An empty table gives no rows."""
    rows = labelled(docs, least)
    least_row = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "text_key"))
    kept = rows.groupBy("component").agg(least_row.alias("m")).select(id_key(F.col("m.doc_id")).alias("d_"), F.col("m.text_key").alias("t_"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), id_key(F.col("doc_id")).alias("d_"), text_key(F.col("text")).alias("t_"))
    return own.join(kept, ["d_", "t_"], "left_semi").dropDuplicates(["d_", "t_"]).select("row_.*")
