"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary text, compared per token.

A pair of neighbouring words counts once in each text of a class. The lower order has Kneser-Ney's continuation counts:
the different words before a word, of the class and, below them, of both classes together (shared):

    p_c(w | v) = max(n_c(v, w) - d, 0) / n_c(v) + left_c(v) p_c(w)
    p_c(w)     = max(N_c(w) - d, 0) / N_c + left_c p(w)
    p(w)       = (N(w) + FLOOR) / sum

where left is what the discounts d took. The discount of a count n is min(n, SHARED * e + DEVIATIONS * sqrt(e) + DISCOUNT) with e
the count that the class would have if it were like both together. So rare expressions, and all those that the classes
share, are smoothed by the shared counts, which are the same in both models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Hashes, crc_mod, id_key, materialize

#: Labelled documents that the models learn from, at most: ordinary and toxic ones, by the order of a hash of their ids.
ROWS = (12_000, 3_000)
#: The discount, see above.
SHARED, DEVIATIONS, DISCOUNT = 2.0, 3.0, 1.0
#: What each word has among the shared counts besides its own.
FLOOR = 0.1
#: Grams with a count left in a class after the discount, at most; they are broadcast. More than that is an error.
MOST_GRAMS = 2_000_000
LEAST_SCORE = 0.7
_WORDS = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_hashes = Hashes()


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words of a text, after a 0 that stands for its start."""
    words = _WORDS((text or "").lower())
    return np.fromiter((0, *map(_hashes.__getitem__, words)), np.uint64, len(words) + 1)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One key for a word (before: 1) or for a pair of neighbours."""
    return (before * _MIX) ^ (word + (before >> np.uint64(29)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys among the sorted ones, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    """Both models where they differ; each array has a row for a class (ordinary, toxic) behind the sorted keys.

    All other words have p_c(w) = left_c p(w), and all other contexts and pairs no counts of their own (left_c(v) = 1), so
    that p(w) is the same factor in both likelihoods and isn't needed for their ratio."""

    words: np.ndarray
    p_word: np.ndarray
    contexts: np.ndarray
    left: np.ndarray
    pairs: np.ndarray
    p_pair: np.ndarray
    left_all: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def mean_ratio(self, hashes: np.ndarray) -> float:
        """Difference of the two log-likelihoods, by token; 0 without tokens."""
        if len(hashes) < 2:
            return 0.0
        before, word = hashes[:-1], hashes[1:]
        p = np.repeat(self.left_all[:, None], len(word), 1)
        at, there = _find(self.words, word)
        p[:, there] = self.p_word[:, at[there]]
        at, there = _find(self.contexts, before)
        p[:, there] *= self.left[:, at[there]]
        at, there = _find(self.pairs, pair_keys(before, word))
        p[:, there] += self.p_pair[:, at[there]]
        return float((np.log(p[1]) - np.log(p[0])).mean())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.mean_ratio(token_hashes(text)) + self.offset, -30, 30))))


def _keys(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.ascontiguousarray(rows[column].to_numpy(np.int64)).view(np.uint64)


def _collect(rows: DataFrame) -> pd.DataFrame:
    found = rows.limit(MOST_GRAMS + 1).toPandas()
    if len(found) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} grams have counts of their own; take fewer labelled rows")
    return found


def taken(n: Column, expected: Column) -> Column:
    """The discount of a count."""
    return F.least(n, SHARED * expected + DEVIATIONS * F.sqrt(expected) + DISCOUNT)


def build(grams: DataFrame, cells: list[Column]) -> Model:
    """A model from grams (v, w). cells: in how many ordinary and toxic texts each pair occurs. Only grams with a count
    left after the discount come to the driver, MOST_GRAMS of either kind at most."""
    n = [F.col("n0"), F.col("n1")]
    counts = grams.select("v", "w", cells[0].cast("double").alias("n0"), cells[1].cast("double").alias("n1")).where("n0 + n1 > 0")
    words = counts.groupBy("w").agg(*[F.count_if(n[c] > 0).cast("double").alias(f"n{c}") for c in (0, 1)], F.count(F.lit(1)).alias("shared"))
    words = materialize(words, "toxicity-words")
    all_ = words.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("shared").alias("shared"), F.count(F.lit(1)).alias("types")).first()
    total = [max(all_[f"n{c}"] or 0.0, 1.0) for c in (0, 1)]
    both = F.col("n0") + F.col("n1")
    words = words.select("w", "shared", *n, *[taken(n[c], both * (total[c] / sum(total))).alias(f"d{c}") for c in (0, 1)])
    left_all = words.agg(*[F.sum(f"d{c}").alias(f"d{c}") for c in (0, 1)]).first()
    left_all = np.array([(left_all[f"d{c}"] or 0.0) / total[c] if all_[f"n{c}"] else 1.0 for c in (0, 1)])

    of = counts.groupBy("v").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in (0, 1)])
    pairs = counts.where("n0 > 1 or n1 > 1").join(of, "v")  # of a count of 1 the discount leaves nothing
    sums = F.col("s0") + F.col("s1")
    pairs = pairs.select("v", "w", "s0", "s1", *n, *[taken(n[c], both * F.col(f"s{c}") / sums).alias(f"d{c}") for c in (0, 1)])
    own = pairs.where("n0 > d0 or n1 > d1")
    two = _collect(own.select("v", "w", *[((n[c] - F.col(f"d{c}")) / F.greatest(F.col(f"s{c}"), F.lit(1.0))).alias(f"p{c}") for c in (0, 1)]))
    contexts = own.groupBy("v").agg(*[F.first(f"s{c}").alias(f"s{c}") for c in (0, 1)], *[F.sum(n[c] - F.col(f"d{c}")).alias(f"k{c}") for c in (0, 1)])
    ctx = _collect(contexts.select("v", *[(1 - F.col(f"k{c}") / F.greatest(F.col(f"s{c}"), F.lit(1.0))).alias(f"l{c}") for c in (0, 1)]))
    told = own.select("w").distinct().withColumn("told", F.lit(True))
    one = _collect(words.join(told, "w", "left").where("n0 > d0 or n1 > d1 or told"))

    smooth = (one["shared"].to_numpy(float) + FLOOR) / ((all_["shared"] or 0) + FLOOR * ((all_["types"] or 0) + 1))
    p_word = np.array([(one[f"n{c}"] - one[f"d{c}"]).to_numpy(float) / total[c] + left_all[c] * smooth for c in (0, 1)])
    # elsewhere left_c p(w) stands for both, without p(w)
    words_, contexts_, pairs_ = _keys(one, "w"), _keys(ctx, "v"), pair_keys(_keys(two, "v"), _keys(two, "w"))
    a, b, c = np.argsort(words_), np.argsort(contexts_), np.argsort(pairs_)
    columns = lambda df, x: df[[f"{x}0", f"{x}1"]].to_numpy(float).T
    return Model(words_[a], p_word[:, a], contexts_[b], columns(ctx, "l")[:, b], pairs_[c], columns(two, "p")[:, c], left_all)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve by Newton steps; a fixed curve where a class is absent."""
    if len(set(y.tolist())) < 2:
        return 50.0, -1.0
    scale = max(float(x.std()), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.diag([1.0, 0.1]), a.T @ ((y - p)) - 0.5 * np.array([1.0, 0.1]) * beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def training_rows(labels: DataFrame, most: tuple[int, int] = ROWS) -> DataFrame:
    """doc_id, toxic, fold of the labelled rows to learn from: crc32 of the id modulo 3 is 0 or 2.
    Rows without id or label are left out; an id with both labels counts as toxic."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = lambda c: rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[c])
    return own(0).unionByName(own(1)).withColumn("fold", (crc_mod(F.col("doc_id"), 3) / 2).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = ROWS) -> Model:
    """Learns from whole texts of at most sum(most) labelled documents. Each half of them is scored by the
    model of the other half; these scores set the curve from mean log ratio to score."""
    chosen = materialize(training_rows(labels, most), "toxicity-rows").withColumnRenamed("doc_id", "tid")
    texts = docs.select(F.col("doc_id").alias("tid"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "tid").select("toxic", "fold", "text")
    texts = materialize(texts, "toxicity-texts")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (toxic, fold), own in b.groupby(["toxic", "fold"]):
                found = []
                for t in own["text"]:
                    h = token_hashes(t)
                    found.append(np.unique(np.column_stack([h[:-1], h[1:]]), axis=0))
                grams, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
                yield pd.DataFrame({"toxic": toxic, "fold": fold, "v": np.ascontiguousarray(grams[:, 0]).view(np.int64), "w": np.ascontiguousarray(grams[:, 1]).view(np.int64), "n": n})

    cell = lambda c, f: F.coalesce(F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == f), F.col("n"))), F.lit(0)).alias(f"c{c}{f}")
    grams = texts.mapInPandas(count, "toxic int, fold int, v bigint, w bigint, n bigint").groupBy("v", "w")
    grams = materialize(grams.agg(*[cell(c, f) for f in (0, 1) for c in (0, 1)]), "toxicity-grams")
    half = lambda f: build(grams, [F.col(f"c{c}{f}") for c in (0, 1)])
    model = build(grams, [F.col(f"c{c}0") + F.col(f"c{c}1") for c in (0, 1)])
    shared = docs.sparkSession.sparkContext.broadcast([half(1), half(0)])

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [shared.value[f].mean_ratio(token_hashes(t)) for f, t in zip(b["fold"], b["text"], strict=True)], "toxic": b["toxic"]})

    seen = texts.mapInPandas(cross, "x double, toxic int").toPandas().sort_values(["x", "toxic"])  # a number for each labelled row
    model.slope, model.offset = logistic(seen["x"].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def scores(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    A null or empty text has the score of no evidence (mean ratio 0); very long texts are scored whole; a null doc_id counts
    as the empty string where it decides what is held out; repeated rows each give a row; without labels of both classes
    every mean ratio is scored on a fixed curve; other columns are left out, whatever their names; an empty table gives no
    rows. Labels, lang, source and doc_id are no inputs of a score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": [shared.value.score(t) for t in b["text"]]})

    rows = docs.select("doc_id", (crc_mod(id_key(F.col("doc_id")), 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
