"""Byte-level BPE: encode with a queue of merge ranks over a linked symbol list, and decode.

The vocabulary file is a parameter; it is shipped to the tasks by broadcast and never copied here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import MEMORIES, released

#: The byte-level split pattern, with white space as Unicode's White_Space property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same split for texts without the characters of ODD, for the faster standard library module.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ODD = r"[^\x00-\x1b\x20-\x7e\u00c0-\u024f]"
#: Pieces of one generation of a task's memory. It holds two: when the young one is full the old one goes, and a piece
#: that is met again moves to the young one. This bounds the memory, not the results.
REMEMBERED = 200_000
#: The lower bits of a queue entry, which hold the place in the piece.
PLACE = 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, the rest follow U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Encodes and decodes with one tokenizer file (the JSON form with vocab, merges and added tokens)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = data["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        #: left id << 32 | right id -> rank, and what the merge of each rank gives
        self.merges: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.of_byte = [vocab.get(c) for c in letters]
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(SPLIT).findall
        self.string_of = {str(i): s for i, s in self.strings.items()}
        self.plain_pieces, self.odd = re.compile(PLAIN_SPLIT).findall, re.compile(ODD).search
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. The queue holds rank << PLACE | place of the left symbol; an entry is stale if the pair
        that now starts there has another rank."""
        ids = [i for b in piece if (i := self.of_byte[b]) is not None]
        n, get, merged = len(ids), self.merges.get, self.merged
        queue = [rank << PLACE | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := get(a << 32 | b)) is not None]
        if not queue:
            return ids
        # -1 stands before the first and after the last symbol; no pair has it
        before, after, place = list(range(-1, n)), list(range(1, n + 1)), (1 << PLACE) - 1
        ids.append(-1)
        push, pop = heapq.heappush, heapq.heappop
        heapq.heapify(queue)
        while queue:
            least = pop(queue)
            i, rank = least & place, least >> PLACE
            j = after[i]
            if get(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: a neighbour has merged since
            own = ids[i] = merged[rank]
            ids[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if (rank := get(own << 32 | ids[k])) is not None:
                push(queue, rank << PLACE | i)
            h = before[i]
            if (rank := get(ids[h] << 32 | own)) is not None:
                push(queue, rank << PLACE | h)
        return [i for i in ids if i >= 0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def remember(self, piece: str) -> str:
        """The ids of a piece that the young generation lacks, as text."""
        found = self.old.get(piece)
        if found is None:
            found = ",".join(map(str, self.merge(piece.encode("utf-8"))))
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[piece] = found
        return found

    def ids_text(self, text: str) -> str:
        """The ids of a whole text, joined by commas."""
        found: list[str] = []
        remember = self.remember
        for k, span in enumerate(self.at_added.split(text) if self.at_added else [text]):
            if k % 2:
                found.append(str(self.added[span]))
            elif span:
                cut = self.pieces(span) if self.odd(span) else self.plain_pieces(span)
                for at in range(0, len(cut), 100_000):
                    get = self.young.get
                    found += [get(p) or remember(p) for p in cut[at : at + 100_000]]
        return ",".join([x for x in found if x])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.ids_text(text).split(",") if i]

    def count(self, text: str | None) -> int:
        joined = self.ids_text(text or "")
        return joined.count(",") + 1 if joined else 0

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, and of the text decoded from them."""
        joined = self.ids_text(text or "")
        ids = joined.split(",") if joined else []
        back = b"".join(map(self.string_of.__getitem__, ids)).decode("utf-8", "replace")
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_codecs: dict[int, Codec] = {}
MEMORIES["bpe"] = _codecs.clear


def _codec(shared) -> Codec:
    """One codec for each Python worker and vocabulary."""
    key = hash(shared.value)
    if key not in _codecs:
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text (null: none), a row for each row, repeated ones too; very long texts are encoded whole, an empty table
    gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(_spec(path))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return pd.Series([codec.encode(t or "") for t in texts])

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of each list of ids (null: empty), a row for each row, repeated ones too; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(_spec(path))

    @F.pandas_udf(T.StringType())
    def run(lists: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return pd.Series([codec.decode([] if x is None else list(x)) for x in lists])

    return docs.withColumn(text, run(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. A null text is empty: no ids,
    the digests of nothing. Repeated rows each give a row, a null doc_id stays null, and other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(_spec(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for b in batches:
            n, ids, text = zip(*map(codec.digest, b["text"]), strict=True) if len(b) else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(released(run, "bpe"), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One column n_tokens: the encoded length of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(_spec(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for b in batches:
            yield pd.DataFrame({"n_tokens": [codec.count(t) for t in b["text"]]}, dtype="int64")

    return docs.select(F.col(text).cast("string").alias("text")).mapInPandas(released(run, "bpe"), "n_tokens bigint")
