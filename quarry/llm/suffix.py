"""Suffix-array dedup: bytes in long strings that also start earlier in the corpus.

Equal windows have the same anchor, the least hash of their grams, so Spark deals the pieces of text around each
anchor out by it, and no match crosses two anchors. Pieces that are the same bytes are settled by their keys. What
is left, pieces that share an anchor but differ, goes through the difference-cover algorithm: sort the triples at
positions 1 and 2 modulo 3, recurse on their names, merge the remaining suffixes, compare adjacent prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, mix, released, text_key, zipped
from quarry.llm.repeats import GRAM, gram_hashes, pieces, sliding

#: Bytes of the strings that count.
WINDOW = 100
#: Bytes of pieces that a task sorts together, about.
SHARD_BYTES = 1_500_000
#: Texts that may share a doc_id (or have none), and the bits that tell them apart.
TEXT_BITS = 20
#: Bytes of texts that a task cuts into pieces together, about.
BATCH_BYTES = 8_000_000
#: An anchor with more different pieces than this is divided by a second anchor, the greatest hash of each window's grams.
HOT_PIECES = 20_000


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The dense rank of each key, from 1."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of each suffix of a text of numbers above 0, by the difference-cover algorithm modulo 3."""
    n = len(text)
    if n < 3:
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(1, n + 1)
        return rank
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with one more place where 1 mod 3 ends at n
    sample = np.concatenate([ones, twos])
    size = int(t.max()) + 1
    names = _ranks(_ranks(t[sample] * size + t[sample + 1]) * size + t[sample + 2]) if size > 1 << 20 else _ranks((t[sample] * size + t[sample + 1]) * size + t[sample + 2])
    if names.max() < len(sample):
        names = suffix_ranks(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    rest = np.arange(0, n, 3)
    wide = len(sample) + 2
    key = t[rest] * wide + rank[rest + 1]
    order = np.argsort(key, kind="stable")
    rest, key = rest[order], key[order]
    in_ones, in_twos = (x[np.argsort(rank[x])] for x in (ones[ones < n], twos))
    before = np.searchsorted(t[in_ones] * wide + rank[in_ones + 1], key)
    # against 2 mod 3 the first two numbers and the rank after them decide; pairs are named by order to keep keys small
    pair = _ranks(np.concatenate([t[in_twos] * size + t[in_twos + 1], t[rest] * size + t[rest + 1]]))
    before += np.searchsorted(pair[: len(in_twos)] * wide + rank[in_twos + 2], pair[len(in_twos) :] * wide + rank[rest + 2])
    merged = np.concatenate([in_ones, in_twos])
    merged = merged[np.argsort(rank[merged])]
    out = np.zeros(n, np.int64)
    place = np.arange(len(rest)) + before
    out[rest] = place + 1
    free = np.ones(n, bool)
    free[place] = False
    out[merged] = np.flatnonzero(free) + 1
    return out


def later_windows(parts: list[bytes], window: int, owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of the windows of the parts that an earlier window equals; owner orders the documents of the
    parts, start is where each part starts in its document."""
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    size = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text[first + size] = 1  # a divider sorts like a zero byte; no window reaches it
    rank = suffix_ranks(text)
    count = size - window + 1
    part = np.repeat(np.arange(len(parts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = first[part] + offset
    order = np.argsort(rank[at])
    at, part, offset = at[order], part[order], offset[order]
    same = np.zeros(len(at), bool)
    raw = text.astype(np.uint8)
    reach = np.arange(window)
    for k in range(1, len(at), 50_000):
        a, b = at[k : k + 50_000], at[k - 1 : k - 1 + len(at[k : k + 50_000])]
        same[k : k + 50_000] = (raw[a[:, None] + reach] == raw[b[:, None] + reach]).all(1)
    group = np.cumsum(~same)
    place = np.lexsort((start[part] + offset, owner[part], group))
    again = np.concatenate([[False], group[place][1:] == group[place][:-1]])
    return part[place][again], offset[place][again]


def _pack(nth: np.ndarray | int, start: np.ndarray, windows: np.ndarray, periodic: np.ndarray | int = 0) -> np.ndarray:
    """Number of the text among those of its doc_id (TEXT_BITS), start (35), windows (7), periodic (1): orders as the start does."""
    return (np.int64(nth) << 43) | (start.astype(np.int64) << 8) | (windows.astype(np.int64) << 1) | np.int64(periodic)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.asarray(at, np.int64)
    return at >> 43, (at >> 8) & ((1 << 35) - 1), (at >> 1) & 127


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """d (the doc_id, or the least long for null), nth, text, and more columns, of each row. Different texts of a doc_id are numbered by their
    digests, from 0; equal ones have one number. Only ids that repeat with another text are looked up."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.col("text").cast("string").alias("text"), *more)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = rows.select("d", h.alias("h")).groupBy("d").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("d")
    shared = materialize(shared, "shared-ids")
    if shared.isEmpty():
        return rows.select("d", F.lit(0).alias("nth"), "text", *more)
    keys = rows.join(shared, "d", "left_semi").select("d", text_key(F.col("text")).alias("key")).distinct()
    keys = keys.withColumn("nth", F.row_number().over(Window.partitionBy("d").orderBy("key")) - 1)
    keys = materialize(keys.withColumn("nth", F.when(F.col("nth") < 1 << TEXT_BITS, F.col("nth")).otherwise(F.raise_error(F.lit("too many texts of one doc_id")).cast("int"))), "texts-of-ids")
    marked = rows.withColumn("key", text_key(F.col("text"))).join(keys, ["d", "key"], "left")
    return marked.select("d", F.coalesce("nth", F.lit(0)).alias("nth"), "text", *more)


def _small(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Ids (with numbers) and texts of about BATCH_BYTES at a time."""
    for b in batches:
        ids, texts, size = [], [], 0
        for d, nth, t in zip(b["d"], b["nth"], b["text"], strict=True):
            ids.append((d, nth))
            texts.append((t or "").encode("utf-8"))
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _find(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of a batch; of those that are the same bytes only the first goes on, the others are settled here."""
        for d_ids, texts in _small(batches):
            found = []
            for (d, nth), raw in zip(d_ids, texts, strict=True):
                anchor, key, start, n, periodic = pieces(np.frombuffer(raw, np.uint8), window)
                if len(anchor):
                    found.append((anchor, key, np.full(len(anchor), d), _pack(nth, start, n, periodic)))
            if not found:
                continue
            anchor, key, d, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, d, key, anchor))
            anchor, key, d, at = anchor[order], key[order], d[order], at[order]
            later = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (key[1:] == key[:-1])])
            yield pd.DataFrame({"anchor": anchor.view(np.int64), "piece": key.view(np.int64), "d": d, "at": at, "later": later})

    return run


def _cut(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bytes of the pieces that are left, with hot anchors divided."""
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows: list[tuple] = []
            for d, nth, packed, wanted in zip(b["d"], b["nth"], b["packed"], b["wanted"], strict=True):
                raw = unzip(packed)
                for w in wanted:
                    own, start, n = _unpack(w["at"])
                    if own != nth:
                        continue
                    data, anchor = raw[start : start + n + window - 1], w["anchor"]
                    if not w["hot"]:
                        rows.append((anchor, d, w["at"], data))
                        continue
                    second = sliding(gram_hashes(np.frombuffer(data, np.uint8))[32], window - GRAM + 1, np.maximum)
                    edge = [0, *(np.flatnonzero(second[1:] != second[:-1]) + 1).tolist(), len(second)]
                    sub = mix(second ^ np.int64(anchor).view(np.uint64)).view(np.int64)
                    for lo, hi in zip(edge, edge[1:], strict=False):
                        rows.append((int(sub[lo]), d, int(_pack(nth, start + lo, np.int64(hi - lo))), data[lo : hi + window - 1]))
            yield pd.DataFrame(rows, columns=["anchor", "d", "at", "data"])

    return run


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows in the order of their anchors, of about SHARD_BYTES bytes, cut only between anchors."""
    held, size = [], 0
    for b in batches:
        while len(b):
            upto = size + np.cumsum(b["data"].map(len).to_numpy())
            full = int(np.searchsorted(upto, SHARD_BYTES))
            anchor = b["anchor"].to_numpy()
            last = anchor[full] if full < len(b) else None
            # the first place at or after the limit where the anchor changes
            cut = full + int(np.argmax(np.append(anchor[full:] != last, True))) if last is not None else len(b)
            held.append(b.iloc[:cut])
            size = int(upto[cut - 1]) if cut else size
            b = b.iloc[cut:]
            if len(b):
                yield pd.concat(held)
                held, size = [], 0
    if held:
        yield pd.concat(held)


def _sort(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows of a shard's pieces that an earlier one equals, as runs."""
        for own in _shards(batches):
            nth, start, _n = _unpack(own["at"].to_numpy())
            # documents in order: by id, then by the number of their text
            _, owner = np.unique(np.rec.fromarrays([own["d"].to_numpy(), nth]), return_inverse=True)
            d = own["d"].to_numpy()
            part, offset = later_windows(own["data"].tolist(), window, owner, start)
            if not len(part):
                continue
            order = np.lexsort((offset, part))
            part, offset = part[order], offset[order]
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (offset[1:] != offset[:-1] + 1)])
            lo = np.flatnonzero(new)
            n = np.diff(np.concatenate([lo, [len(part)]]))
            yield pd.DataFrame({"d": d[part[lo]], "at": _pack(0, start[part[lo]] + offset[lo], n) | (nth[part[lo]] << 43)})

    return run


def spans(data_length: int, start: np.ndarray, windows: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows."""
    if not len(start):
        return []
    order = np.argsort(start)
    lo, hi = start[order], (start + windows + window - 1)[order]
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    ends = np.concatenate([reach[np.flatnonzero(new)[1:] - 1], reach[-1:]])
    return [(int(a), min(int(b), data_length)) for a, b in zip(lo[new], ends, strict=True)]


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """d, at: runs of windows that an earlier window equals, in docs as numbered() gives them."""
    found = docs.mapInPandas(released(_find(window), "suffix"), "anchor bigint, piece bigint, d bigint, at bigint, later boolean")
    same = Window.partitionBy("anchor", "piece").orderBy("d", "at")
    group = Window.partitionBy("anchor")
    rows = found.withColumn("nth", F.row_number().over(same)).withColumn("later", F.col("later") | (F.col("nth") > 1))
    rows = rows.withColumn("kinds", F.sum(F.when(~F.col("later"), 1).otherwise(0)).over(group))
    rows = rows.where(F.col("later") | (F.col("kinds") > 1) | (F.col("at").bitwiseAND(1) == 1))
    rows = materialize(rows.select("anchor", "d", "at", "later", (F.col("kinds") > HOT_PIECES).alias("hot")), "pieces")
    left = rows.where("not later")
    wanted = left.groupBy("d").agg(F.collect_list(F.struct("at", "anchor", "hot")).alias("wanted"))
    cut = packed(docs).join(wanted, "d").mapInPandas(released(_cut(window), "suffix"), "anchor bigint, d bigint, at bigint, data binary")
    sorted_ = cut.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(released(_sort(window), "suffix"), "d bigint, at bigint")
    return rows.where("later").select("d", "at").unionByName(sorted_)


def packed(docs: DataFrame) -> DataFrame:
    """d, nth and the compressed UTF-8 bytes of each text of numbered()."""
    return docs.select("d", "nth", zipped(F.col("text")).alias("packed"))


def _kept(raw: bytes, nth: int, runs, window: int) -> tuple[list[tuple[int, int]], bytes]:
    of, start, n = _unpack(np.array([] if runs is None else runs, np.int64))
    own = of == nth
    cut = spans(len(raw), start[own], n[own], window)
    at, kept = 0, []
    for lo, hi in cut:
        kept.append(raw[at:lo])
        at = hi
    return cut, b"".join([*kept, raw[at:]])


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    A null text is empty, as is any text shorter than the window free of removals; very long texts are taken whole; a null
    doc_id comes before all others; rows that repeat a doc_id and text are one document and get the same result each,
    rows that repeat a doc_id with other texts are documents of their own, in an order of their texts' digests; other
    columns are left out; an empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = numbered(docs)
    runs = repeats(docs, window).groupBy("d").agg(F.collect_list("at").alias("runs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for d, nth, z, r in zip(b["d"], b["nth"], b["packed"], b["runs"], strict=True):
                raw = unzip(z)
                cut, kept = _kept(raw, nth, r, window)
                out.append((d, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = packed(docs).join(runs, "d", "left").mapInPandas(released(run, "suffix"), "d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return done.select(F.when(F.col("d") != -(2**63), F.col("d")).cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated bytes removed from each text; broken characters at the edges of a removal are left out.
    Rows whose text is removed whole go. n_chars, where there is such a column, is counted anew; a null text stays null.
    Rows that repeat an id and a text are one document and lose the same bytes. Very long texts are read whole, other columns stay
    whatever their names; an empty table gives no rows."""
    own = numbered(docs)
    runs = repeats(own, window).groupBy("d").agg(F.collect_list("at").alias("runs"))

    @F.pandas_udf("string")
    def run(texts: pd.Series, nth: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, n, r in zip(texts, nth, lists, strict=True):
            out.append(t if t is None or r is None else _kept(t.encode("utf-8"), n, r, window)[1].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))
    marked = numbered(whole, "row_").join(runs, "d", "left")
    # as if not deterministic: else Spark moves the condition below and runs the function once for it and once for the result
    marked = marked.select("row_", run.asNondeterministic()("text", "nth", "runs").alias("left_"))
    marked = marked.where(F.col("left_").isNull() | (F.col("left_") != "") | (F.col("row_.text") == ""))
    new = {"text": F.col("left_"), "n_chars": F.length("left_").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return marked.select(*[new[c].alias(c) if c in new else F.col(f"row_.`{c}`").alias(c) for c in docs.columns])
