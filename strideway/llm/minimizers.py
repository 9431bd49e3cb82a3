"""Splitting sequences into segments that repeats agree on.

A window of W units (words or bytes) holds W - g + 1 runs of g units; the run with the smallest
hash, the leftmost of equals, is the window's minimizer. Equal windows have equal minimizers, so a window can only
repeat where its minimizer's hash does. Neighbouring windows mostly share one: a segment is a run
of windows with one key, and all of a key's segments together hold every repeat of their windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Low bits of a value that hold a position: pieces are shorter than this many units.
PLACE = 21
PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= A
    h ^= h >> np.uint64(29)
    h *= B
    h ^= h >> np.uint64(32)
    return h


def doubled(h: np.ndarray, g: int) -> np.ndarray:
    """Hashes of every g neighbouring units, g a power of two, from those of single units."""
    span = 1
    while span < g:
        h = mixed(h[:-span] * C + h[span:]) if len(h) > span else h[:0]
        span *= 2
    return h


def byte_hashes(b: np.ndarray, g: int) -> np.ndarray:
    """Hashes of every g neighbouring bytes; g is a power of two, 8 or more."""
    if len(b) < g:
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(b) - 7,), "<u8", np.ascontiguousarray(b), strides=(1,)).astype(np.uint64)
    h, span = mixed(eight), 8
    while span < g:
        h = mixed(h[:-span] * C + h[span:])
        span *= 2
    return h


def least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[:-rest], v[rest:]) if rest else v


@dataclass
class Segments:
    start: np.ndarray  # first window's first unit
    n: np.ndarray  # windows
    key: np.ndarray  # int64
    multi: np.ndarray  # whether the key's run of units occurs more than once inside


def segments(grams: np.ndarray, bounds: np.ndarray, window: int, g: int) -> Segments:
    """Segments of several sequences laid end to end. grams: hash of every g units; bounds: offsets of the sequences, from 0 to the number of units."""
    none = np.empty(0, np.int64)
    width = window - g + 1
    total = int(bounds[-1])
    if total < window:
        return Segments(none, none, none, none.astype(bool))
    place = np.arange(len(grams), dtype=np.uint64)
    low = least((grams >> np.uint64(PLACE) << np.uint64(PLACE)) | place, width)
    at = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    ok = np.zeros(total + 1, np.int8)
    long = np.diff(bounds) >= window
    np.add.at(ok, bounds[:-1][long], 1)
    np.add.at(ok, bounds[1:][long] - window + 1, -1)
    starts = np.flatnonzero(ok[: len(at)].cumsum(dtype=np.int8) > 0)
    if not len(starts):
        return Segments(none, none, none, none.astype(bool))
    at = at[starts]
    key = grams[at].view(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1)
    moved = np.zeros(len(starts), np.int64)
    moved[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(starts)))
    moved[first] = 0
    return Segments(starts[first], n, key[first], np.add.reduceat(moved, first) > 0)
