"""Phrases of a dictionary in texts: a trie of words with failure links where the dictionary is small, a join of runs of words
beyond that."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries up to which a dictionary is sent to all tasks as a trie (some 20 MB).
MOST_ENTRIES = 50_000
#: Words of the longest phrase.
LONGEST = 6
WORD = r"[\p{L}\p{N}_]+"


def words_of(text):
    """The lower-cased words of a text: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


class Trie:
    """Finds all entries in a row of words in one pass: after each word the state is the longest entry's beginning that ends
    there, and links lead on to the shorter ones."""

    def __init__(self, entries: Sequence[tuple[Sequence[str], int]]):
        """entries: words and a number of each."""
        self.next: list[dict[str, int]] = [{}]
        self.numbers: list[list[int]] = [[]]
        self.depth = [0]
        for words, number in entries:
            at = 0
            for w in words:
                if w not in self.next[at]:
                    self.next[at][w] = len(self.next)
                    self.next.append({})
                    self.numbers.append([])
                    self.depth.append(self.depth[at] + 1)
                at = self.next[at][w]
            self.numbers[at].append(number)
        self.link = [0] * len(self.next)
        self.shorter = [0] * len(self.next)  # the nearest state down the links at which an entry ends
        todo = list(self.next[0].values())
        for at in todo:  # by depth, as it grows
            for w, child in self.next[at].items():
                to = self.link[at]
                while to and w not in self.next[to]:
                    to = self.link[to]
                self.link[child] = self.next[to].get(w, 0)
                todo.append(child)
            to = self.link[at]
            self.shorter[at] = to if self.numbers[to] else self.shorter[to]

    def all(self, words: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """(place, words, number) of each entry that stands in the words."""
        at = 0
        for k, w in enumerate(words):
            while at and w not in self.next[at]:
                at = self.link[at]
            at = self.next[at].get(w, 0)
            end = at
            while end:
                for number in self.numbers[end]:
                    yield k - self.depth[end] + 1, self.depth[end], number
                end = self.shorter[end]

    def longest(self, words: Sequence[str]) -> list[tuple[int, int, int]]:
        """Of all() those that are taken from left to right, of those at one place the longest, without overlaps."""
        found, free = [], 0
        for at, size, number in sorted(self.all(words), key=lambda x: (x[0], -x[1], x[2])):
            if at >= free:
                found.append((at, size, number))
                free = at + size
        return found


def entries_of(dictionary: DataFrame) -> DataFrame:
    """words, label of a dictionary (phrase, label): each phrase once, with its least label; phrases without words or with more
    than LONGEST go."""
    rows = dictionary.select(words_of(F.col("phrase")).alias("words"), "label").where(F.col("label").isNotNull() & F.size("words").between(1, LONGEST))
    return rows.groupBy("words").agg(F.min("label").alias("label"))


def matches(texts: DataFrame, dictionary: DataFrame, longest: bool = True, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """key, place, size, phrase, label: where phrases (phrase, label) of a dictionary stand in texts (key, text), by whole
    lower-cased words. With `longest` as Trie.longest() takes them, else all of them.

    The size of the dictionary is counted first: up to `most_entries` it goes to all tasks as a trie, beyond that the runs of up to
    LONGEST words of the texts are joined with it by the phrase."""
    entries = entries_of(dictionary)
    rows = texts.select("key", words_of(F.col("text")).alias("words"))
    kind = texts.schema["key"].dataType.simpleString()
    known = entries.orderBy("words").limit(most_entries + 1).collect()
    if len(known) <= most_entries:
        trie = Trie([(r["words"], n) for n, r in enumerate(known)])
        named = [(" ".join(r["words"]), r["label"]) for r in known]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(k, at, size, *named[n]) for k, w in zip(b["key"], b["words"], strict=True) for at, size, n in (trie.longest(w) if longest else trie.all(w))]
                yield pd.DataFrame(out, columns=["key", "place", "size", "phrase", "label"])

        return rows.mapInPandas(run, f"key {kind}, place int, size int, phrase string, label string")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("place"), n.alias("size"), F.array_join(F.slice("words", i + 1, n), " ").alias("phrase")))).otherwise(F.array().cast("array<struct<place:int,size:int,phrase:string>>"))))
    found = rows.select("key", F.inline(runs)).join(entries.select(F.array_join("words", " ").alias("phrase"), "label"), "phrase")
    if not longest:
        return found.select("key", "place", "size", "phrase", "label")
    # a text's own matches are one array, in the order in which they are taken
    own = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("size")).alias("less"), "phrase", "label"))).alias("all"))
    start = F.struct(F.lit(0).alias("free"), F.slice("all", 1, 0).alias("taken"))
    step = lambda s, x: F.when(x["place"] >= s["free"], F.struct((x["place"] - x["less"]).alias("free"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)
    taken = own.select("key", F.explode(F.aggregate("all", start, step)["taken"]).alias("x"))
    return taken.select("key", "x.place", (-F.col("x.less")).alias("size"), "x.phrase", "x.label")


def entities(found: DataFrame, most: int = 10) -> DataFrame:
    """key, label, phrases: the distinct phrases of matches() by label, in the order in which they first stand in the text, `most`
    of each label."""
    first = found.groupBy("key", "label", "phrase").agg(F.min("place").alias("place"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase"))), lambda x: x["phrase"])
    return first.groupBy("key", "label").agg(F.slice(ordered, 1, most).alias("phrases"))


def expanded(rows: DataFrame, tags: str, groups: DataFrame) -> DataFrame:
    """rows (key, an array `tags`) with, behind the tags, the words of each group (group, word) that has one of them, in any
    case. Tags meet the groups in a join; a key's tags are few."""
    own = rows.select("key", F.posexplode(tags).alias("at", "tag")).withColumn("word", F.lower("tag"))
    g = groups.select("group", F.lower("word").alias("word")).distinct()
    more = own.join(g, "word").select("key", "group").distinct().join(g, "group").groupBy("key").agg(F.array_sort(F.collect_set("word")).alias("more"))
    return rows.join(more, "key", "left").withColumn(tags, F.array_distinct(F.concat(tags, F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
