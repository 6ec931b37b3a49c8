"""Collocations: an FM-index over the word ids of each shard counts its phrases, Spark adds the shards up and scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, mix
from quarry.llm.fmindex import PhraseIndex

LONGEST = 3
LEAST = 10
#: Words of one shard, about; it bounds a task's memory (some 150 bytes a word).
SHARD_WORDS = 1_000_000
#: A phrase whose words occur in a longer candidate with this share of its own occurrences is a part of that one.
PART_PERCENT = 50
BEST = 2000
#: Words and pairs with more than 1 / HOT of all occurrences: fewer than HOT.
HOT = 1000
#: Bits of the filter of frequent pairs (8 MB), a power of two of at least 2^16.
FILTER_BITS = 2**26
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]+")


def pieces(text: bytes) -> list[bytes]:
    """The words of a text in order, A-Z lower-cased, with b"." between pieces. Bytes of other letters stay as they are."""
    return _ENDS.sub(b" . ", text.lower()).split()


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, lang, words (distinct), counts, ids (32-bit numbers, zero between pieces, else place in words + 1).

    A task cuts its own documents, by language, into shards of about `shard_words` words, so texts aren't shuffled. A cut lies
    between pieces; only a piece that is longer than a shard makes a larger one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[bytes, int]] = {}
        ids: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pd.DataFrame:
            of, own, _ = known.pop(lang), np.concatenate(ids.pop(lang)), size.pop(lang)
            counts = np.bincount(own)[1:]
            words = [w.decode("utf-8", "replace") for w in islice(of, 1, len(counts) + 1)]  # later ones are the next shard's
            return pd.DataFrame({"lang": [lang], "words": [words], "counts": [counts], "ids": [own.astype(np.int32).tobytes()]})

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                found = pieces(bytes(text))
                if not found:
                    continue
                of = known.setdefault(lang, {b".": 0})
                own = np.fromiter((of.setdefault(w, len(of)) for w in found), np.int32, len(found))
                at = 0
                while at < len(own):
                    room = shard_words - size.get(lang, 0)
                    end = len(own)
                    if end - at > room:  # the piece that reaches the end of the shard is its last one
                        ends = np.flatnonzero(own[at + max(room, 1) - 1 :] == 0)
                        end = at + max(room, 1) + int(ends[0]) if len(ends) else end
                    part = own[at:end]
                    if at and lang not in known:  # a new shard numbers its words anew
                        of = known[lang] = {b".": 0}
                        part = np.fromiter((of.setdefault(w, len(of)) for w in found[at:end]), np.int32, end - at)
                    ids.setdefault(lang, []).extend((part, np.zeros(1, np.int32)))
                    size[lang] = size.get(lang, 0) + len(part)
                    at = end
                    if size[lang] >= shard_words:
                        yield flush(lang)
        for lang in list(known):
            if lang in ids:
                yield flush(lang)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text)
    cut = rows.mapInPandas(run, "lang string, words array<string>, counts array<bigint>, ids binary")
    return cut.withColumn("shard", F.monotonically_increasing_id())


def numbered(counts: DataFrame) -> DataFrame:
    """counts (materialised here) with number: 0, 1, 2, ... in the order of the files' rows, without a sort."""
    rows = materialize(counts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("row", 33).alias("part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("k")).collect()  # one row for each task that wrote
    starts, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts[r["part"]], total = total, total + r["k"]
    if total >= 2**31:
        raise OverflowError("more than 2^31 words")
    start = rows.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "part bigint, start bigint")
    return rows.join(F.broadcast(start), part == start["part"]).select(*counts.columns, (F.col("start") + F.col("row").bitwiseAND(2**33 - 1)).alias("number"))


def pair_bucket(pair: np.ndarray) -> np.ndarray:
    """The place of a pair of word numbers in the filter."""
    return (mix(pair.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes, set at the places of the pairs (first). Tasks make slices of 64 Kbit, so the driver and each task
    get FILTER_BITS / 8 bytes, whatever the number of pairs; with very many pairs the filter only lets more through."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = pair_bucket(b["first"].to_numpy())
            yield pd.DataFrame({"slice": at >> 16, "place": at & 0xFFFF}).drop_duplicates()

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        bits[rows["place"].to_numpy()] = 1
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    slices = pairs.select("first").mapInPandas(places, "slice bigint, place bigint").distinct().groupBy("slice").applyInPandas(packed, "slice bigint, bits binary")
    found = np.zeros((FILTER_BITS >> 16, 1 << 13), np.uint8)
    for r in slices.collect():
        found[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return found.reshape(-1)


def passes(pair: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = pair_bucket(pair)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def phrase_counts(cut: DataFrame, words: DataFrame, length: int, bits: np.ndarray | None = None) -> DataFrame:
    """first (two numbers of words in 32 bits each), third (number or -1), a, left, right: the phrases of `length` (2 or 3) of the
    given words (lang, word, number), added up over the shards; left and right count the occurrences with a word of their piece
    before and behind. With the bits of a filter, which only phrases of 3 have, those whose pairs don't pass it are left out
    before they leave a shard."""
    of = cut.select("shard", "lang", F.posexplode("words").alias("place", "word")).join(words, ["lang", "word"]).select(F.col("shard").alias("of"), "place", "number")

    def run(shard: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        columns = ["first", "third", "a", "left", "right"]
        if len(shard) and len(some):
            ids = np.frombuffer(shard["ids"][0], np.int32)
            number = some["number"].to_numpy(np.int64)
            own = np.ones(int(ids.max()) + 1, np.int32)  # 0 separates, 1 stands for all other words, 2 ... are the given ones
            own[0] = 0
            own[some["place"].to_numpy() + 1] = np.arange(2, len(number) + 2, dtype=np.int32)
            text = own[ids]
            if bits is not None:  # words in no pair that passes are other words; a run of these is one
                both = (text[:-1] > 1) & (text[1:] > 1)
                at = np.flatnonzero(both)
                both[at] = passes(number[text[at] - 2] << 32 | number[text[at + 1] - 2], bits)
                used = np.zeros(len(text), bool)
                used[:-1] |= both
                used[1:] |= both
                text = np.where(used | (text == 0), text, 1).astype(np.int32)
                text = text[np.concatenate([[True], (text[1:] != text[:-1]) | (text[1:] > 1)])]
            *_, level = PhraseIndex(text, length).levels(least_word=2)
            if level.words.shape[1] == length:
                w = number[level.words - 2]
                first, third = w[:, 0] << 32 | w[:, 1], w[:, 2] if length > 2 else np.full(len(w), -1)
                found = pd.DataFrame(dict(zip(columns, (first, third, level.count, level.left, level.right), strict=True)))
                return found if bits is None else found[passes(first, bits) & passes(w[:, 1] << 32 | w[:, 2], bits)]
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})

    each = cut.select("shard", "ids").groupBy("shard").cogroup(of.groupBy("of")).applyInPandas(run, "first bigint, third bigint, a bigint, left bigint, right bigint")
    return each.groupBy("first", "third").agg(*[F.sum(c).alias(c) for c in ("a", "left", "right")])


def with_values(rows: DataFrame, key: str, table: DataFrame, least_hot: float, **names: str) -> DataFrame:
    """rows with columns of table (its key: `key_`, its occurrences: `a_`) that has each key once; names: new column -> old one.

    Keys with more than least_hot occurrences, fewer than HOT, are broadcast, and their rows take no part in the shuffle join."""
    hot = table.where(F.col("a_") > least_hot).select("key_", *[F.col(old).alias(f"hot_{new}") for new, old in names.items()], F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), rows[key] == hot["key_"], "left").drop("key_")
    elsewhere = F.when(F.col("hot"), -1 - F.pmod(F.xxhash64("first", "third"), F.lit(10_007))).otherwise(F.col(key))
    rest = table.where(F.col("a_") <= least_hot).select("key_", *[F.col(old).alias(new) for new, old in names.items()])
    both = rows.withColumn("at_", elsewhere).join(rest, F.col("at_") == F.col("key_"), "left").drop("key_", "at_", "hot")
    return both.withColumns({new: F.coalesce(f"hot_{new}", new) for new in names}).drop(*[f"hot_{new}" for new in names])


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits."""
    d = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"({d(a)} * {d(a)} * cast(1000000 as decimal(7, 0))) div ({d(left)} * {d(right)})")


def candidates(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score, within (the occurrences of its most frequent longer candidate), left, right of each
    phrase of 2 to LONGEST words that occurs `least` times or more."""
    cut = materialize(shards(docs, shard_words), "shards")
    counts = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    total = cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("n"))
    least_hot = max((total.agg(F.sum("n")).first()[0] or 0) / HOT, LEAST)
    words = numbered(counts.where(F.col("f") >= least))  # a frequent phrase has frequent words only
    known = words.select("lang", "word", "number")
    pairs = materialize(phrase_counts(cut, known, 2).where(F.col("a") >= least), "pairs")  # so has a frequent phrase frequent pairs
    grams = pairs.unionByName(materialize(phrase_counts(cut, known, 3, pair_filter(pairs)).where(F.col("a") >= least), "triples"))

    number = lambda c, by: F.shiftright(c, by).bitwiseAND(2**32 - 1)
    word = words.select(F.col("number").alias("key_"), F.col("f").alias("a_"), "lang", "word")
    pair = pairs.select(F.col("first").alias("key_"), F.col("a").alias("a_"))
    rows = grams.select("*", number("first", 32).alias("w1"), number("first", 0).alias("w2"))
    rows = with_values(rows, "w1", word, least_hot, f1="a_", word1="word", lang="lang")
    rows = with_values(rows, "w2", word, least_hot, f2="a_", word2="word")
    two = rows.where("third < 0").withColumns({"l": F.col("f1"), "r": F.col("f2"), "score": score("a", "f1", "f2"), "phrase": F.concat_ws(" ", "word1", "word2"), "size": F.lit(2)})
    three = rows.where("third >= 0").withColumn("last_two", F.shiftleft("w2", 32).bitwiseOR(F.col("third")))
    three = with_values(three, "third", word, least_hot, f3="a_", word3="word")
    three = with_values(with_values(three, "first", pair, least_hot, f12="a_"), "last_two", pair, least_hot, f23="a_")
    three = three.withColumns({"s1": score("a", "f1", "f23"), "s2": score("a", "f12", "f3")}).withColumn("early", F.col("s1") <= F.col("s2"))
    three = three.withColumns({
        "l": F.when(F.col("early"), F.col("f1")).otherwise(F.col("f12")), "r": F.when(F.col("early"), F.col("f23")).otherwise(F.col("f3")),
        "score": F.least("s1", "s2"), "phrase": F.concat_ws(" ", "word1", "word2", "word3"), "size": F.lit(3), "within": F.lit(None).cast("bigint"),
    })
    of = three.select(F.explode(F.array("first", "last_two")).alias("first"), "a").groupBy("first").agg(F.max("a").alias("within"))
    columns = ["lang", "phrase", "size", "a", "l", "r", "score", "within", "left", "right"]
    return two.join(of, "first", "left").select(columns).unionByName(three.select(columns)).join(total, "lang")


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, part_percent: int = PART_PERCENT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, left_n, right_n: each language's first `best` phrases by score.

    A-Z are lower-cased; pieces end at .,;:!? and line ends, words at spaces and tabs. Null texts are empty, a null language is
    `und`, rows that repeat count as often as they stand, very long texts are cut into shards between pieces and lose nothing.
    Ties go by more occurrences, then by the phrase's UTF-8 bytes. Columns other than text and lang are left out. An empty table
    gives no rows."""
    found = candidates(docs, least, shard_words).where(F.col("within").isNull() | (100 * F.col("within") < part_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("left").alias("left_n"), F.col("right").alias("right_n"))
