"""Content-chosen anchors: where two documents share a window, they choose the same anchor in it."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of every k consecutive values, built by doubling."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    base, span, have = 0x9E3779B97F4A7C15, 1, values.astype(np.uint64)
    out, done = None, 0
    rest = k
    while rest:
        if rest & 1:
            n = len(values) - done - span + 1
            if out is None:
                out = have[:n].copy()
            else:
                out = out[:n] * np.uint64(pow(base, span, 1 << 64)) + have[done : done + n]
            done += span
        rest >>= 1
        if rest:
            have = have[:-span] * np.uint64(pow(base, span, 1 << 64)) + have[span:]
            span *= 2
    return mixed(out) | np.uint64(1)  # never 0, which stands for no window


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - width + span], x[width - span :]) if span < width else x


def anchored(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place): windows first..last of ``width`` hashes have their leftmost smallest hash at place.

    The ranges cover every window once, in order. Equal windows have their
    place at the same distance and thus equal anchors.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = _slide(hashes, width, np.minimum)
    around = np.zeros(n + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + n] = low
    place = np.flatnonzero(_slide(around, width, np.maximum) == hashes)
    value = hashes[place]
    first = np.r_[0, np.where(value[:-1] <= value[1:], place[:-1] + 1, place[1:] - width + 1)]
    last = np.minimum(np.r_[np.minimum.accumulate(first[::-1])[::-1][1:], n], n) - 1
    full = first <= last
    return first[full], last[full], place[full]
