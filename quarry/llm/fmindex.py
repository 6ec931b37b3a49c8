"""A depth-limited bidirectional FM-index over word ids, all intervals of a depth extended at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sorted_places(words: np.ndarray, depth: int) -> np.ndarray:
    """The places of words in the order of their first `depth` words up to a separator (0); the order of ties is of no matter."""
    n, width = len(words), int(words.max(initial=0)) + 1
    key, open_ = words.astype(np.int64), words > 0
    for k in range(1, depth):
        following = np.zeros(n, np.int32)
        following[: max(n - k, 0)] = words[k:]
        open_ &= following > 0
        following[~open_] = 0
        if int(key.max(initial=0)) >= 2**62 // width:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key *= width
        key += following
    return np.argsort(key).astype(np.int32)


@dataclass
class Level:
    """The phrases of one length: their words, intervals in both directions, occurrences, and how many of these have a word
    of the same piece before and behind them."""

    words: np.ndarray  # phrases x length
    low: np.ndarray
    high: np.ndarray
    reverse_low: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.high - self.low


class Direction:
    """One direction's transform: the word before each place in sorted order, and where each word's rows begin."""

    def __init__(self, words: np.ndarray, depth: int):
        order = sorted_places(words, depth)
        self.before = words[order - 1]  # the first place follows the last one: both hold a separator
        self.first = words[order]
        self.words_before = np.zeros(len(words) + 1, np.int32)
        np.cumsum(self.before > 0, out=self.words_before[1:])

    def followed(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many rows of each interval have a word before them."""
        return self.words_before[high] - self.words_before[low]


class PhraseIndex:
    """Counts the phrases of up to `depth` words in a text of word ids, where 0 separates pieces.

    Sorting by `depth` words is enough: the rows of a phrase of up to that length are an interval, and the rows before which
    a word stands map in order onto the interval of the longer phrase."""

    def __init__(self, words: np.ndarray, depth: int):
        """words: integers from 0 on; it need not begin or end with a separator."""
        words = np.concatenate([[0], np.asarray(words, np.int32), [0]]).astype(np.int32)
        self.depth = depth
        self.ahead, self.back = Direction(words, depth), Direction(words[::-1], depth)
        #: The row that each row comes from: row q is the row source[q] with its word in front.
        self.source = (np.sort(self.ahead.before.astype(np.int64) * len(words) + np.arange(len(words))) % len(words)).astype(np.int32)

    def levels(self, least_word: int = 1):
        """A Level for each length from 1 on, of the phrases whose words are all `least_word` or more.

        A step puts each word that stands before an interval in front of its phrase. The new interval is read off the rows
        that these rows map to; in the other direction it begins where the smaller words before the interval end."""
        first, n = self.ahead.first, len(self.ahead.first)
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        ends = np.concatenate([starts[1:], [n]])
        level = Level(first[starts][:, None], starts, ends, starts.copy(), self.ahead.followed(starts, ends), self.back.followed(starts, ends))
        keep = level.words[:, 0] >= least_word
        level = Level(*(getattr(level, f)[keep] for f in level.__dataclass_fields__))
        phrase = np.full(n, -1, np.int32)  # the phrase of each row
        for length in range(1, self.depth + 1):
            yield level
            if length == self.depth or not len(level.low):
                return
            phrase[:] = -1
            sizes = level.count
            phrase[np.repeat(level.low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] = np.repeat(np.arange(len(sizes)), sizes)
            level = self._longer(level, phrase, least_word)

    def _longer(self, level: Level, phrase: np.ndarray, least_word: int) -> Level:
        first, parent = self.ahead.first, phrase[self.source]
        starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (parent[1:] != parent[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(first)]]))
        word, of = first[starts], parent[starts]
        real = of >= 0
        starts, sizes, word, of = starts[real], sizes[real], word[real], of[real]
        # within a phrase its longer forms come by their first word, separators first; their sizes add up to their places
        order = np.lexsort((word, of))
        starts, sizes, word, of = starts[order], sizes[order], word[order], of[order]
        total = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begins = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        reverse_low = level.reverse_low[of] + total - np.maximum.accumulate(np.where(begins, total, 0)) if len(of) else total[:0]
        keep = word >= least_word
        low, sizes, word, of, reverse_low = starts[keep], sizes[keep], word[keep], of[keep], reverse_low[keep]
        words = np.concatenate([word[:, None], level.words[of]], axis=1)
        return Level(words, low, low + sizes, reverse_low, self.ahead.followed(low, low + sizes), self.back.followed(reverse_low, reverse_low + sizes))
