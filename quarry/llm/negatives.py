"""Hard negatives: an inverted multi-index over the halves of vectors, whose cells are visited best bound first until nothing
that is left can reach a window."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

ANCHORS, MOVED = 100, 7
LABELS = 10
SCALE = 256
POSITIVES = NEGATIVES = 5
LOW_PERCENT = 80
#: Rows that a cell should have, and codewords of a half at most.
CELL_ROWS, MOST_WORDS = 1024, 64
#: Rows that the codebooks are fitted on (every row is indexed), and rounds of fitting.
SAMPLE, FITS = 20_000, 6
#: Rows of one shard, about: what a task holds at a time.
SHARD_ROWS = 8192
#: Rows that a first look at the best cells takes in, which gives each window a floor.
SEED_ROWS = 2000


@dataclass
class Codebooks:
    """Codewords of both halves, and for each cell (place in the first book * number of the second + place in the second) its
    rows, the largest distances of its half vectors to their codewords, its first shard and number of shards."""

    books: tuple[np.ndarray, np.ndarray]
    kind: str
    rows: np.ndarray | None = None
    radii: np.ndarray | None = None
    first_shard: np.ndarray | None = None
    shards: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.books[0].shape[1] + self.books[1].shape[1]

    def vectors(self, packed) -> np.ndarray:
        return np.stack([np.frombuffer(x, self.kind) for x in packed]) if len(packed) else np.zeros((0, self.width), self.kind)

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.books[0].shape[1]
        return v[:, :at].astype(float), v[:, at:].astype(float)

    def visits(self, vector: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(cell, bound of it and all later ones, bound of its own): the cells with rows, by the sum of their halves' bounds.

        A half's bound is the codeword's inner product plus the vector's norm times the largest radius of that codeword. The
        halves are sorted by it, and a heap over their pairs gives the next best sum. Bounds have a margin for rounding."""
        n1, n2 = len(self.books[0]), len(self.books[1])
        half = [h[0] for h in self.halves(vector[None])]
        norms = [math.sqrt(float(h @ h)) for h in half]
        inner = [b @ h for b, h in zip(self.books, half, strict=True)]
        r = self.radii.reshape(n1, n2, 2)
        sums = [inner[0] + norms[0] * r[:, :, 0].max(1), inner[1] + norms[1] * r[:, :, 1].max(0)]
        orders = [np.argsort(-s, kind="stable") for s in sums]
        best = [s[o].tolist() for s, o in zip(sums, orders, strict=True)]
        own = inner[0][:, None] + inner[1][None] + norms[0] * r[:, :, 0] + norms[1] * r[:, :, 1]
        margin = 1 + 1e-9 * sum(n * float(np.abs(b).max(initial=0) + x.max(initial=0)) for n, b, x in zip(norms, self.books, (r[:, :, 0], r[:, :, 1]), strict=True)) * self.width
        heap, seen = [(-(best[0][0] + best[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < n1 and y < n2 and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(best[0][x] + best[1][y]), x, y))
            cell = int(orders[0][i]) * n2 + int(orders[1][j])
            if self.rows[cell]:
                yield cell, -bound + margin, float(own.flat[cell]) + margin


def fitted(sample: np.ndarray, words: int) -> np.ndarray:
    """Codewords of half vectors: means of the nearest ones, from evenly spaced first ones on."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    book = np.unique(sample[np.linspace(0, len(sample) - 1, words).astype(int)], axis=0)
    for _ in range(FITS):
        near, _ = nearest(sample, book)
        sizes = np.bincount(near, minlength=len(book))
        total = np.stack([np.bincount(near, weights=sample[:, k], minlength=len(book)) for k in range(sample.shape[1])], axis=1) if sample.shape[1] else np.zeros((len(book), 0))
        book = np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], book)
    return book


def nearest(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each half vector and the distance to it."""
    near = ((book * book).sum(1)[None] - 2 * half @ book.T).argmin(1)
    return near, np.sqrt(((half - book[near]) ** 2).sum(1))


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id (0 for null), no_id, label, q of the rows that take part: labels moved, components in whole steps of 1 / SCALE."""
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("bigint")
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), label.alias("label"), F.transform(vector, lambda x: F.floor(x * SCALE)).alias("q"))


def index(rows: DataFrame, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, Codebooks]:
    """row, vec_id, no_id, label, q (packed), cell, shard of each row (quantised()), and the codebooks. A shorter vector ends in zeros.

    The codebooks, of at most MOST_WORDS codewords each, are fitted on at most SAMPLE rows, those of the least row hashes. A
    cell's rows make up whole shards or share one with other cells."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width"), F.max(F.array_max("q")).alias("most"), F.min(F.array_min("q")).alias("least")).first()
    width, most = size["width"] or 0, max(abs(size["most"] or 0), abs(size["least"] or 0))
    kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "int64"
    if width * most * most >= 2**63:
        raise OverflowError("inner products of these vectors may pass 64 bits")

    def padded(qs) -> np.ndarray:
        out = np.zeros((len(qs), width), kind)
        for k, q in enumerate(qs):
            out[k, : len(q)] = q
        return out

    some = padded([r["q"] for r in rows.select("q").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()]).astype(float)
    words = min(max(math.ceil(math.sqrt(size["n"] / cell_rows)), 1), MOST_WORDS)
    at = width // 2
    codes = Codebooks((fitted(some[:, :at], words), fitted(some[:, at:], words)), kind)
    n2 = len(codes.books[1])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = padded(b["q"].tolist())
            (near1, far1), (near2, far2) = (nearest(h, book) for h, book in zip(codes.halves(v), codes.books, strict=True))
            yield pd.DataFrame({"row": b["row"], "vec_id": b["vec_id"], "no_id": b["no_id"], "label": b["label"], "q": [x.tobytes() for x in v], "cell": near1 * n2 + near2, "far1": far1, "far2": far2})

    found = materialize(rows.mapInPandas(coded, "row bigint, vec_id bigint, no_id boolean, label bigint, q binary, cell bigint, far1 double, far2 double"), "coded")
    cells = len(codes.books[0]) * n2
    codes.rows, codes.radii = np.zeros(cells, np.int64), np.zeros((cells, 2))
    for r in found.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("a"), F.max("far2").alias("b")).collect():  # MOST_WORDS ** 2 rows at most
        codes.rows[r["cell"]], codes.radii[r["cell"]] = r["n"], (r["a"], r["b"])
    codes.shards = np.maximum(-(-codes.rows // shard_rows), 1)
    codes.first_shard = np.zeros(cells, np.int64)
    shard = room = 0
    for cell in np.flatnonzero(codes.rows):
        if codes.rows[cell] > room:
            shard, room = shard + 1, shard_rows
        codes.first_shard[cell] = shard
        if codes.shards[cell] > 1:
            shard, room = shard + codes.shards[cell] - 1, 0
        else:
            room -= codes.rows[cell]
    of = rows.sparkSession.createDataFrame([(int(c), int(codes.first_shard[c]), int(codes.shards[c])) for c in np.flatnonzero(codes.rows)] or [(0, 0, 1)], "cell bigint, first bigint, k bigint")
    placed = found.join(F.broadcast(of), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("k")))
    return placed.select("row", "vec_id", "no_id", "label", "q", "cell", "shard"), codes


def asked(anchors: DataFrame, codes: Codebooks, seed_rows: int | None) -> DataFrame:
    """shard, row, label, q, cells, tops: what each anchor (row, label, q, tops, floor) asks of each shard.

    It visits cells until the bound of all that are left is under its floor, or until it has seen seed_rows rows if these are
    given. It leaves out a cell whose own bound is under the floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, label, q, tops, floor in zip(b["row"], b["label"], b["q"], b["tops"], b["floor"], strict=True):
                wanted: dict[int, list[int]] = {}
                seen = 0
                for cell, bound, own in codes.visits(np.frombuffer(q, codes.kind)):
                    if bound < floor or seed_rows is not None and seen >= seed_rows:
                        break
                    if own >= floor:
                        seen += int(codes.rows[cell])
                        for k in range(int(codes.shards[cell])):
                            wanted.setdefault(int(codes.first_shard[cell]) + k, []).append(cell)
                out.extend((s, row, label, q, cells, tops) for s, cells in wanted.items())
            yield pd.DataFrame(out, columns=["shard", "row", "label", "q", "cells", "tops"])

    return anchors.select("row", "label", "q", "tops", "floor").mapInPandas(run, "shard bigint, row bigint, label bigint, q binary, cells array<bigint>, tops array<bigint>")


class Shard:
    """The rows of one shard, by cell, with exact scores."""

    def __init__(self, parts: list[pd.DataFrame], codes: Codebooks):
        rows = pd.concat(parts).sort_values("cell", kind="stable", ignore_index=True)
        self.rows, self.codes = rows, codes
        self.label, self.cell = rows["label"].to_numpy(np.int64), rows["cell"].to_numpy(np.int64)
        self.vectors = codes.vectors(rows["q"].tolist()).astype(np.int64)
        self.most = int(np.abs(self.vectors).max(initial=0))
        self.plain = self.vectors.astype(float)
        by_id = rows.sort_values(["no_id", "vec_id", "row"]).index.to_numpy()
        self.rank = np.empty(len(rows), np.int64)
        self.rank[by_id] = np.arange(len(rows))

    def scores(self, vector: np.ndarray, at: np.ndarray) -> np.ndarray:
        v = vector.astype(np.int64)
        if len(v) * self.most * int(np.abs(v).max(initial=0)) < 2**53:  # whole numbers of a double: exact
            return (self.plain[at] @ v.astype(float)).astype(np.int64)
        return self.vectors[at] @ v

    def best(self, score: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """The places of the `most` best scores, ties by the smaller id."""
        if len(at) > 8 * most:
            least = np.partition(score, len(score) - most)[len(score) - most]
            may = score >= least
            score, at = score[may], at[may]
        return np.lexsort((self.rank[at], -score))[:most], at, score


def answers(rows: DataFrame, asks: DataFrame, codes: Codebooks, positives: bool) -> DataFrame:
    """anchor, place, score, vec_id, no_id, row, rank: the best rows for each anchor and window, ranked (rank from 1).

    Rows and questions of a shard meet in one task, rows first; a task holds one shard. Without windows (positives) the best
    rows of the anchor's label count, else for each top the best of other labels from LOW_PERCENT of it up to it."""
    lit = lambda value, kind: F.lit(value).cast(kind)
    a = rows.withColumns({"cells": lit(None, "array<bigint>"), "tops": lit(None, "array<bigint>"), "asks": F.lit(0)})
    b = asks.withColumns({"vec_id": lit(0, "bigint"), "no_id": F.lit(False), "cell": lit(0, "bigint"), "asks": F.lit(1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts, shard = None, [], None
        for batch in batches:
            for (number, is_ask), part in batch.groupby(["shard", "asks"], sort=True):
                if number != current:
                    current, parts, shard = number, [], None
                if not is_ask:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if shard is None:
                    shard = Shard(parts, codes)
                    parts = [part.iloc[:0]]
                whole, found = len(np.unique(shard.cell)), []
                for row, label, q, cells, tops in zip(part["row"], part["label"], part["q"], part["cells"], part["tops"], strict=True):
                    at = np.arange(len(shard.cell)) if len(cells) == whole else np.flatnonzero(np.isin(shard.cell, cells))
                    score = shard.scores(np.frombuffer(q, codes.kind), at)
                    own = shard.label[at] == label
                    if positives:
                        may = own & (shard.rows["row"].to_numpy()[at] != row)
                        windows = [(0, may)]
                    else:
                        windows = [(k, ~own & (score <= top) & (score >= -(-LOW_PERCENT * int(top) // 100))) for k, top in enumerate(tops)]
                    for k, may in windows:
                        chosen, places, values = shard.best(score[may], at[may], POSITIVES if positives else NEGATIVES)
                        found.append(pd.DataFrame({"anchor": row, "place": k, "score": values[chosen], "at": places[chosen]}))
                if found:
                    out = pd.concat(found)
                    of = shard.rows.iloc[out["at"]]
                    yield pd.DataFrame({"anchor": out["anchor"].to_numpy(np.int64), "place": out["place"].to_numpy(np.int64), "score": out["score"].to_numpy(np.int64), "vec_id": of["vec_id"].to_numpy(), "no_id": of["no_id"].to_numpy(), "row": of["row"].to_numpy()})

    met = a.unionByName(b).repartition("shard").sortWithinPartitions("shard", "asks")
    each = met.mapInPandas(run, "anchor bigint, place bigint, score bigint, vec_id bigint, no_id boolean, row bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "no_id", "vec_id", "row")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (POSITIVES if positives else NEGATIVES))


def hard_negatives(embeddings: DataFrame, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part; labels move where vec_id is divisible
    by MOVED; a component is floor(SCALE * x). Anchors are the rows whose vec_id is divisible by ANCHORS, positives the best
    POSITIVES other rows of the anchor's label, negatives for each positive the best NEGATIVES rows of other labels that score
    from LOW_PERCENT of the positive's score up to it. Ties go to the smaller vec_id (null last), then to the earlier row.
    Rows that repeat a vec_id are rows of their own, each an anchor; a null vec_id is no anchor and moves no label. A vector
    shorter than the longest counts as ending in zeros. Columns other than vec_id, embedding and label are left out; an empty
    table gives no rows. Scores that may pass 64 bits raise an error.

    All results are exact. A first look at each anchor's best cells gives a floor; then it visits all cells whose bound reaches
    that floor, first for its positives, then, with their scores as the tops of windows, for its negatives."""
    rows, codes = index(quantised(embeddings), cell_rows, shard_rows)
    rows = materialize(rows, "index")
    none = float("-inf")
    anchors = materialize(rows.where(~F.col("no_id") & (F.col("vec_id") % ANCHORS == 0)).select("row", "vec_id", "label", "q"), "anchors")

    first = anchors.withColumns({"tops": F.array().cast("array<bigint>"), "floor": F.lit(none)})
    seeds = answers(rows, asked(first, codes, seed_rows), codes, True).where(F.col("rank") == POSITIVES).select(F.col("anchor").alias("row"), F.col("score").cast("double").alias("floor"))
    second = first.drop("floor").join(seeds, "row", "left").fillna({"floor": none})
    positive = materialize(answers(rows, asked(second, codes, None), codes, True), "positives")

    tops = positive.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("tops"))
    windows = anchors.join(tops, "row")
    lowest = F.array_min("tops").cast("double")
    least = lowest * (LOW_PERCENT / 100) - F.abs(lowest) * 1e-9 - 1  # a margin for rounding
    third = windows.withColumn("floor", least)
    seeds = answers(rows, asked(third, codes, seed_rows), codes, False).where(F.col("rank") == NEGATIVES).groupBy(F.col("anchor").alias("row")).agg(F.count(F.lit(1)).alias("full"), F.min("score").cast("double").alias("reached"))
    fourth = third.join(seeds, "row", "left").withColumn("floor", F.when(F.col("full") == F.size("tops"), F.greatest("floor", "reached")).otherwise(F.col("floor")))
    negative = answers(rows, asked(fourth, codes, None), codes, False)

    known = F.when(~F.col("no_id"), F.col("vec_id"))
    p = positive.select("anchor", (F.col("rank") - 1).alias("place"), known.alias("positive_id"), F.col("score").alias("positive_score"))
    n = negative.select("anchor", "place", F.col("rank").cast("int").alias("rank"), known.alias("negative_id"), F.col("score").alias("negative_score"))
    found = p.join(n, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
