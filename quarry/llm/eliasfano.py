"""Elias-Fano sequences and an n-gram trie over them, whose levels are views into one mapped buffer.

Nothing is unpacked: an element is found by select over the packed bits, with a count for each block of 512 bits."""

from __future__ import annotations

import mmap

import numpy as np

#: Steps of the quantised log probabilities; 0 stands for no entry.
STEPS = 65535
LOWEST = -20.0
#: Words of 64 bits in one sampled block.
SAMPLE = 8
#: Places that are looked up together, which bounds the memory of a lookup.
TOGETHER = 100_000
_IN_BYTE = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _set = [k for k in range(8) if _byte >> k & 1]
    _IN_BYTE[_byte, : len(_set)] = _set


def quantise(log10: np.ndarray) -> np.ndarray:
    return (1 + np.rint(np.clip(log10 / LOWEST, 0, 1) * (STEPS - 1))).astype(np.uint16)


def value_of(codes: np.ndarray) -> np.ndarray:
    """The probability of a code; 0 for no entry."""
    return np.where(codes == 0, 0.0, 10.0 ** ((codes.astype(float) - 1) / (STEPS - 1) * LOWEST))


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The packed arrays of a sequence below `universe` that doesn't fall: its size and low bits, the lower parts, the upper
    parts in unary, and the ones before each block of these."""
    n = len(values)
    low_bits = max(int(universe // max(n, 1)).bit_length() - 1, 0)
    v = values.astype(np.uint64)
    low = np.zeros((n * low_bits >> 6) + 2, np.uint64)
    if low_bits:
        part = v & np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, part << shift)
        over = shift + np.uint64(low_bits) > 64
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    # each element's 1 comes after as many 0s as its upper part says
    place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    size = n + (universe >> low_bits) + 1
    high = np.zeros(-(-size // (64 * SAMPLE)) * SAMPLE, np.uint64)
    np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, SAMPLE).sum(1, dtype=np.int64))])
    return {"head": np.array([n, low_bits, universe], np.int64), "low": low, "high": high, "ones": ones}


class EliasFano:
    """A sequence in the arrays of encode(), which may be views into a mapped file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits, self.universe = map(int, arrays["head"])
        self.low_words, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]

    def _select(self, i: np.ndarray, one: bool) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        before = self.ones if one else np.arange(len(self.ones)) * (64 * SAMPLE) - self.ones
        for a in range(0, len(i), TOGETHER):
            left = i[a : a + TOGETHER].astype(np.int64)
            block = np.searchsorted(before, left, "right") - 1
            left = left - before[block]
            words = self.high[block[:, None] * SAMPLE + np.arange(SAMPLE)]
            words = words if one else ~words
            k, left, word = _step(words, left)
            b, left, byte = _step(word.view(np.uint8).reshape(-1, 8), left)
            out[a : a + TOGETHER] = (block * SAMPLE + k) * 64 + b * 8 + _IN_BYTE[byte, left]
        return out

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        left = self.low_words[word] >> shift
        right = np.where(shift > 0, self.low_words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (left | right) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The elements at the places i."""
        return ((self._select(i, True) - i) << self.low_bits) | self.low(i).astype(np.int64)

    def find(self, values: np.ndarray, first: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each value among the elements from `first` up to `end`, or -1: the upper part leads to the elements
        that share it, and of these the successor by the lower part is searched by halves. The sequence must rise."""
        v = np.where((values >= 0) & (values < self.universe), values, 0).astype(np.int64)
        high, want = v >> self.low_bits, (v & ((1 << self.low_bits) - 1)).astype(np.uint64)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        hi = self._select(high, False) - high
        lo, hi = np.maximum(lo, first), np.minimum(hi, self.n if end is None else end)
        hi = np.where((values >= 0) & (values < self.universe), hi, lo)
        out = np.full(len(v), -1, np.int64)
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) // 2
            got = self.low(mid)
            hit = got == want[left]
            out[left[hit]] = mid[hit]
            under = got < want[left]
            lo[left] = np.where(under, mid + 1, lo[left])
            hi[left] = np.where(under, hi[left], mid)
            left = left[~hit & (lo[left] < hi[left])]
        return out


def _step(cells: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first cell of each row up to which more than `left` bits are set, what is left of them there, and the cell."""
    upto = np.cumsum(np.bitwise_count(cells), 1, dtype=np.int64)
    k = (upto <= left[:, None]).sum(1)
    row = np.arange(len(cells))
    return k, left - np.where(k > 0, upto[row, np.maximum(k - 1, 0)], 0), cells[row, k]


class Trie:
    """Contexts with their backoff weights; pointers to where each one's successors start, which never fall; and the
    successors with their probabilities, all quantised.

    A successor is stored as its word number plus the last value before its context's range, so that the whole level is
    one rising sequence of small steps; a lookup goes to the context's range over the pointers and looks for the word
    relative to it."""

    LEVELS = ("contexts", "pointers", "successors")

    def __init__(self, buffer) -> None:
        """buffer: bytes or a mapped file with what pack() gives."""
        count = int(np.frombuffer(buffer, np.int64, 1)[0])
        places = np.frombuffer(buffer, np.int64, 3 * count, 8).reshape(-1, 3)
        kinds = {0: np.int64, 1: np.uint64, 2: np.uint16}
        views = [np.frombuffer(buffer, kinds[int(k)], int(n), int(at)) for k, at, n in places]
        of = lambda i: EliasFano(dict(zip(("head", "low", "high", "ones"), views[4 * i : 4 * i + 4], strict=True)))
        self.contexts, self.pointers, self.successors = map(of, range(3))
        self.backoff, self.codes = views[12:14]

    @staticmethod
    def pack(contexts: np.ndarray, backoff: np.ndarray, context_of: np.ndarray, words: np.ndarray, codes: np.ndarray) -> bytes:
        """contexts rise; context_of and words (from 1 on, rising inside a context) are the successors' level."""
        n = len(contexts)
        start = np.searchsorted(context_of, np.arange(n + 1))
        last = words[start[1:] - 1] if n and len(words) else np.zeros(n, np.int64)
        base = np.concatenate([[0], np.cumsum(last)]).astype(np.int64)
        level = base[context_of] + words if len(words) else words
        parts = []
        for values, top in ((contexts, int(contexts[-1]) + 1 if n else 1), (start, len(words) + 1), (level, int(base[-1]) + 1)):
            parts += encode(np.asarray(values, np.int64), top).values()
        parts += [backoff, codes]
        kind = {np.dtype(np.int64): 0, np.dtype(np.uint64): 1, np.dtype(np.uint16): 2}
        at, places = 8 + 24 * len(parts), []
        for x in parts:
            at += -at % 8
            places.append((kind[x.dtype], at, len(x)))
            at += x.nbytes
        out = bytearray(at)
        out[: 8 + 24 * len(parts)] = np.concatenate([[len(parts)], np.array(places, np.int64).ravel()]).astype(np.int64).tobytes()
        for (_, p, _), x in zip(places, parts, strict=True):
            out[p : p + x.nbytes] = np.ascontiguousarray(x).tobytes()
        return bytes(out)

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the successor (0: not seen) and of the context's backoff weight (0: not seen)."""
        own, of = np.unique(contexts, return_inverse=True)
        k = self.contexts.find(own)
        seen = k >= 0
        at = np.where(seen, k, 0)
        back = np.zeros(len(own), np.uint16)
        back[seen] = self.backoff[k[seen]]
        if not seen.any():
            return np.zeros(len(of), np.uint16), back[of]
        first, end = self.pointers.access(at), self.pointers.access(at + 1)
        base = np.where(first > 0, self.successors.access(np.maximum(first - 1, 0)), 0)
        j = self.successors.find(base[of] + words, first[of], np.where(seen, end, first)[of])
        code = np.zeros(len(of), np.uint16)
        code[j >= 0] = self.codes[j[j >= 0]]
        return code, back[of]


def mapped(packed: bytes) -> mmap.mmap:
    """The packed trie in memory that is mapped, not in Python's own."""
    at = mmap.mmap(-1, max(len(packed), 1))
    at.write(packed)
    return at
