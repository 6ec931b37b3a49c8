"""Language-model scoring with an Elias-Fano n-gram trie whose parts are dealt out over the cluster.

Documents are held in blocks. A block asks for just the words and word pairs that it holds, once each: the words'
counts come from tasks that own a part of the vocabulary, the pairs' probabilities from tasks that build and map the
part of the trie below their contexts. So nothing that grows with the corpus is broadcast or held whole."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, materialize
from quarry.llm.eliasfano import Trie, mapped, quantise, value_of

#: Tokens of one block, about.
BLOCK = 3_000_000
#: Parts that the vocabulary and the trie are dealt out in, at most; else as many as there are blocks. A part is one group, so
#: beyond this many blocks (2 * 10**11 tokens) groups grow with the corpus.
MOST_PARTS = 1 << 16
#: What is taken off a pair's count and given to its last word's own probability.
DISCOUNT = 0.75


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end, which is the empty string."""
    words = (text or "").encode("utf-8").lower().split()
    words.append(b"")
    return words


def _zip(x: np.ndarray | bytes) -> bytes:
    """Compressed; of an array all first bytes of its numbers, then all second ones and so on, which packs closer."""
    if not isinstance(x, bytes):
        x = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(x: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    if kind is None:
        return raw
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, held, sizes, ids (of the tokens in the block's own vocabulary), words, counts (in training texts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth = 0
        for b in batches:
            doc_ids, held, texts, at = [None if pd.isna(x) else x for x in b["doc_id"]], b["held"].tolist(), b["text"].tolist(), 0
            while at < len(texts):
                first, total, known, parts = at, 0, {}, []
                while at < len(texts) and total < BLOCK:
                    t = tokens(texts[at])
                    parts.append(np.fromiter([known.setdefault(w, len(known)) for w in t], np.int32, len(t)))
                    total, at = total + len(t), at + 1
                ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int32)
                training = np.repeat(~np.array(held[first:at], bool), sizes)
                yield pd.DataFrame({
                    "block": [(TaskContext.get().partitionId() << 24) + nth], "doc_ids": [doc_ids[first:at]], "held": [held[first:at]], "sizes": [_zip(sizes)], "ids": [_zip(ids)],
                    "words": [_zip(b"\n".join(known))], "counts": [_zip(np.bincount(ids[training], minlength=len(known)).astype(np.int64))],
                })
                nth += 1

    rows = docs.select("doc_id", (crc_mod(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 7) == 2).alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, f"block bigint, doc_ids array<{kind}>, held array<boolean>, sizes binary, ids binary, words binary, counts binary")


def _parts_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))


def _ask_words(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, packed, counts in zip(b["block"], b["words"], b["counts"], strict=True):
                words, n = _unzip(packed).split(b"\n"), _unzip(counts, np.int64)
                of = _parts_of(words, parts)
                order = np.argsort(of, kind="stable")
                edge = np.searchsorted(of[order], np.arange(parts + 1))
                rows = [(p, block, _zip(b"\n".join([words[i] for i in order[lo:hi]])), _zip(n[order[lo:hi]])) for p, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False)) if hi > lo]
                yield pd.DataFrame(rows, columns=["part", "block", "words", "counts"])

    return run


def _count_words(parts: int):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """The corpus's count and number of each word that a block asked for; and the part's totals."""
        known: dict[bytes, int] = {}
        asked = [[known.setdefault(w, len(known)) for w in _unzip(x).split(b"\n")] for x in b["words"]]
        total = np.zeros(len(known), np.int64)
        for ids, n in zip(asked, b["counts"], strict=True):
            total[ids] += _unzip(n, np.int64)
        number = np.arange(len(known), dtype=np.int64) * parts + key[0] + 1  # 0 is the start of a text
        return pd.DataFrame({
            "block": b["block"], "kind": 0, "part": key[0], "a": [_zip(number[i]) for i in asked], "b": [_zip(total[i]) for i in asked],
            "n": total.sum(), "types": (total > 0).sum(), "once": (total == 1).sum(), "twice": (total == 2).sum(),
        })

    return run


_ANSWER = "block bigint, kind int, part bigint, a binary, b binary, n bigint, types bigint, once bigint, twice bigint"


def _of_words(block: pd.Series, answers: pd.DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each word of the block's vocabulary."""
    words = _unzip(block["words"]).split(b"\n")
    of = _parts_of(words, parts)
    number, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for p, a, c in zip(answers["part"], answers["a"], answers["b"], strict=True):
        at = np.flatnonzero(of == p)
        number[at], count[at] = _unzip(a, np.int64), _unzip(c, np.int64)
    return number, count


def _pairs(block: pd.Series, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct pairs as (before << 32) + word, sorted; and for each token its pair and whether it trains."""
    ids, sizes = _unzip(block["ids"], np.int32), _unzip(block["sizes"], np.int32)
    word = number[ids]
    before = np.concatenate([[0], word[:-1]])
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 0
    if len(number) and number.max() >= 1 << 31:
        raise OverflowError("more words than a pair's key holds")
    keys, at = np.unique((before << 32) + word, return_inverse=True)
    return keys, at, np.repeat(~np.array(list(block["held"]), bool), sizes)


def _ask_pairs(parts: int):
    def run(key: tuple, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        number, _ = _of_words(row, answers, parts)
        keys, at, training = _pairs(row, number)
        counts = np.bincount(at[training], minlength=len(keys))
        of = (keys >> 32) % parts
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(parts + 1))
        rows = [(p, row["block"], _zip(np.diff(keys[order[lo:hi]], prepend=0)), _zip(counts[order[lo:hi]].astype(np.int32))) for p, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False)) if hi > lo]
        return pd.DataFrame(rows, columns=["part", "block", "keys", "counts"])

    return run


def _look_up(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """Builds the part of the trie below this part's contexts and looks up what each block asked for."""
    asked = [np.cumsum(_unzip(k, np.int64)) for k in b["keys"]]
    every, at = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(at, np.concatenate([_unzip(c, np.int32) for c in b["counts"]]).astype(float), len(every))
    every, counts = every[counts > 0], counts[counts > 0]
    contexts, of = np.unique(every >> 32, return_inverse=True)
    total, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))
    backoff = quantise(np.log10(DISCOUNT * kinds / np.maximum(total, 1))) if len(contexts) else np.zeros(0, np.uint16)
    codes = quantise(np.log10((counts - DISCOUNT) / total[of])) if len(every) else np.zeros(0, np.uint16)
    trie = Trie(mapped(Trie.pack(contexts, backoff, of, every & 0xFFFFFFFF, codes)))
    found = [trie.lookup(k >> 32, k & 0xFFFFFFFF) for k in asked]
    return pd.DataFrame({"block": b["block"], "kind": 1, "part": key[0], "a": [_zip(c) for c, _ in found], "b": [_zip(w) for _, w in found], "n": 0, "types": 0, "once": 0, "twice": 0})


def _score(parts: int, n_all: int, types: int, discount: float):
    def run(key: tuple, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        number, count = _of_words(row, answers[answers["kind"] == 0], parts)
        keys, at, _ = _pairs(row, number)
        of = (keys >> 32) % parts
        pair, weight = np.zeros(len(keys)), np.ones(len(keys))
        two = answers[answers["kind"] == 1]
        for p, a, w in zip(two["part"], two["a"], two["b"], strict=True):
            own = np.flatnonzero(of == p)
            pair[own] = value_of(_unzip(a, np.uint16))
            back = _unzip(w, np.uint16)
            weight[own] = np.where(back == 0, 1.0, value_of(back))
        n = max(n_all, 1)
        single = np.where(count > 0, value_of(quantise(np.log10(np.maximum(count - discount, 1e-9) / n))), discount * types / n if n_all else 1.0)
        ids, sizes = _unzip(row["ids"], np.int32), _unzip(row["sizes"], np.int32)
        per_token = np.log10(np.minimum(pair[at] + weight[at] * single[ids], 1.0))
        base = np.log10((count + 1) / (n_all + types + 1))[ids]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return pd.DataFrame({
            "doc_id": list(row["doc_ids"]), "held_out": list(row["held"]), "n_tokens": sizes.astype(np.int64), "n_known": np.add.reduceat((count > 0)[ids].astype(np.int64), first),
            "train_tokens": n_all, "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(per_token, first),
        })

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text, from a pair model
    (interpolated absolute discounting) of the documents that aren't held out.

    A null text is empty and has the one token end; a null doc_id counts as the empty string where it decides what is
    held out; repeated rows each give a row and each train; without training texts every probability of the model is 1
    and the base is that of an empty corpus; an empty table gives no rows. The score takes an unseen word as one class,
    as the base does."""
    held = materialize(blocks(docs), "blocks")
    parts = min(max(held.count(), 1), MOST_PARTS)
    asked = held.select("block", "words", "counts").mapInPandas(_ask_words(parts), "part bigint, block bigint, words binary, counts binary")
    one = materialize(asked.groupBy("part").applyInPandas(_count_words(parts), _ANSWER), "word-answers")
    totals = one.groupBy("part").agg(*[F.max(c).alias(c) for c in ("n", "types", "once", "twice")]).agg(*[F.sum(c).alias(c) for c in ("n", "types", "once", "twice")]).first()
    n_all, types, once, twice = (int(totals[c] or 0) for c in ("n", "types", "once", "twice"))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    pairs = held.groupBy("block").cogroup(one.groupBy("block")).applyInPandas(_ask_pairs(parts), "part bigint, block bigint, keys binary, counts binary")
    two = materialize(pairs.groupBy("part").applyInPandas(_look_up, _ANSWER), "pair-answers")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return held.groupBy("block").cogroup(one.unionByName(two).groupBy("block")).applyInPandas(_score(parts, n_all, types, discount), out)
