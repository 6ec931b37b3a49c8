"""Finds windows of a text that may occur elsewhere: each window's anchor is the least hash of its grams."""

from __future__ import annotations

import numpy as np

from quarry.llm.common import GOLDEN as _G
from quarry.llm.common import mix

#: Bytes of a gram.
GRAM = 32
#: Windows of one piece, at most.
PIECE = 93


def gram_hashes(data: np.ndarray, least: int = 1) -> dict[int, np.ndarray]:
    """Hashes of the 32 and 64 bytes from each position on."""
    h, size, found = data.astype(np.uint64) + np.uint64(1), 1, {}
    while size < 64:
        h = h[:-size] * _G + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
        if size in (8, 32, 64):
            h = mix(h)
        if size >= 32:
            found[size] = h
    return found


def sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over each `width` neighbours, by doubling."""
    done, y = 1, x
    while 2 * done <= width:
        y = take(y[:-done], y[done:])
        done *= 2
    return take(y[: len(x) - width + 1], y[width - done : len(x) - done + 1]) if width > done else y


def pieces(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, key, start, windows, periodic) of the runs of windows that share an anchor.

    Equal windows have equal anchors. Pieces with equal anchor and key are the same bytes. periodic marks runs
    in which one window may occur twice."""
    n = len(data) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    grams = gram_hashes(data)
    h, h64 = grams[32], grams[64]
    width = window - GRAM + 1
    least = sliding(h, width, np.minimum)
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([start, [n]]))
    if (size > PIECE).any():  # only where a stretch repeats itself
        parts = -(-size // PIECE)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        offset = (np.arange(parts.sum()) - first) * PIECE
        size = np.minimum(np.repeat(size, parts) - offset, PIECE)
        start = np.repeat(start, parts) + offset
    anchor = least[start]
    length = size + window - 1
    key = mix(mix(h64[start] * _G + h64[start + np.minimum(64, length - 64)]) * _G + h64[start + length - 64] + length.astype(np.uint64))
    # anchors' own places: a gram that is the least of some window around it
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == sliding(np.concatenate([pad, least, pad]), width, np.maximum))
    order = np.lexsort((at, h[at]))
    value, place = h[at][order], at[order]
    close = (value[1:] == value[:-1]) & (np.diff(place) <= width)
    return anchor, key, start, size, np.isin(anchor, value[1:][close])
