"""Removal of repeated byte strings by suffix arrays, sorted in two stages.

Texts are UTF-8 bytes. A shard's passages (see repeats) are laid end to end. Of their suffixes only
those smaller than their successors are sorted directly; the others are induced by scanning the
buckets of first bytes from the smallest: each suffix in turn puts the one that starts a byte
earlier, if that is larger, at the end of what its bucket has so far. The common prefixes of neighbours in that
order then tell which windows occur more than once. Order matters to the window's length only, so
sorting stops there.

Cases: a null or empty text has no bytes; texts shorter than a window lose nothing; every
occurrence of a repeated window goes, the first as well; rows that share a key are documents of their own,
so what a repeated row holds repeats; matches never reach over a document's end; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideway.llm.common import slices
from strideway.llm.repeats import Units, found_batch, numbered, ranges_of, removed, repeated, runs_of

#: Windows that are sorted together, about.
TOGETHER = 1 << 17
#: Bytes of a shard.
MOST = 1 << 19


def _words_at(t: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from every place, which compare like the bytes do."""
    return np.ndarray((len(t) - 7,), ">u8", t, strides=(1,))


def _offsets(window: int) -> list[int]:
    """Where eight bytes are read so that together they cover a window."""
    return [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]


def _sorted(eight: np.ndarray, pos: np.ndarray, window: int) -> np.ndarray:
    """pos in the order of their windows' bytes; equal windows side by side."""
    offs = _offsets(window)
    k = eight[pos].astype(np.uint64)
    order = np.argsort(k, kind="stable")
    pos, k = pos[order], k[order]
    out = pos.copy()
    new = np.concatenate([[True], k[1:] != k[:-1]])
    slot = np.arange(len(pos))  # places in out of those still undecided
    for r, off in enumerate(offs[1:], 1):
        group = new.cumsum() - 1
        size = np.bincount(group)
        open_ = size[group] > 1
        pos, slot, group = pos[open_], slot[open_], group[open_]
        if not len(pos):
            break
        if r in (2, 4, 8, 16):  # groups of equal windows are done
            lead = np.concatenate([[True], group[1:] != group[:-1]])
            head = pos[np.flatnonzero(lead)][lead.cumsum() - 1]
            same = np.ones(len(pos), bool)
            for o in offs[r:]:
                at = np.flatnonzero(same)
                same[at] = eight[pos[at] + o] == eight[head[at] + o]
            number = lead.cumsum() - 1
            mixed_ = np.zeros(number[-1] + 1, bool)
            mixed_[number[~same]] = True
            left = mixed_[number]
            pos, slot, group = pos[left], slot[left], group[left]
            if not len(pos):
                break
        k = eight[pos + off].astype(np.uint64)
        order = np.lexsort((k, group))
        pos, k, group = pos[order], k[order], group[order]
        out[slot] = pos
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (group[1:] != group[:-1])])
    return out


def suffix_array(t: np.ndarray, wanted: np.ndarray, window: int) -> np.ndarray:
    """The wanted places of t (a mask) by their suffixes' first `window` bytes. t goes on for 2 * window bytes past the last wanted place."""
    n = len(t)
    # smaller[i]: suffix i is smaller than suffix i + 1. Equal bytes are decided by the next different one; the last by convention.
    step = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16)).astype(np.int8)
    at = np.flatnonzero(step)
    smaller = np.ones(n, bool)
    # Every place up to a difference is decided by that difference.
    if len(at):
        smaller[: at[-1] + 1] = np.repeat(step[at] > 0, np.diff(at, prepend=-1))
    # A larger suffix is induced by its successor, which so has to be in the array too.
    direct_at = np.flatnonzero(smaller)
    have = wanted.copy()
    ends = np.flatnonzero(wanted[:-1] & ~wanted[1:]) + 1
    stop = direct_at[np.minimum(direct_at.searchsorted(ends), len(direct_at) - 1)]
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, ends, 1)
    np.add.at(delta, stop + 1, -1)
    have |= delta[:n].cumsum() > 0
    larger = have & ~smaller
    direct = _sorted(_words_at(t), np.flatnonzero(have & smaller), window)
    firsts = t[direct]
    cuts = firsts.searchsorted(np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(part: np.ndarray, c: int) -> np.ndarray:
        """Put the predecessors of part into their buckets; those of bucket c itself are returned."""
        j = part[part > 0] - 1
        j = j[larger[j]]
        if not len(j):
            return j
        b = t[j]
        order = np.argsort(b, kind="stable")
        j, b = j[order], b[order]
        edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        own = j[:0]
        for first, some in zip(b[edge].tolist(), np.split(j, edge[1:]), strict=True):
            if first == c:
                own = some
            else:
                buckets[first].append(some)
        return own

    for c in range(256):
        wave = np.concatenate(buckets[c]) if buckets[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        part = direct[cuts[c] : cuts[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    sa = np.concatenate(out) if out else direct
    return sa[wanted[sa]]


def common_prefixes(t: np.ndarray, sa: np.ndarray, window: int) -> np.ndarray:
    """Bytes that neighbours in sa share, up to the window."""
    eight = _words_at(t)
    a, b = sa[:-1], sa[1:]
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for off in _offsets(window):
        x = eight[a[alive] + off].astype(np.uint64) ^ eight[b[alive] + off].astype(np.uint64)
        ends = np.flatnonzero(x)
        shared = np.zeros(len(ends), np.int64)
        for byte in range(1, 8):
            shared += x[ends] >> np.uint64(64 - 8 * byte) == 0
        out[alive[ends]] = np.maximum(out[alive[ends]], off + shared)
        alive = alive[x == 0]
        out[alive] = off + 8
    return out


def repeated_windows(passages: list[bytes], counts: list[int], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each passage, which of its first `count` windows occur more than once among all passages, and which are the first of their kind."""
    sizes = np.asarray([len(p) for p in passages])
    t = np.frombuffer(b"".join(passages) + b"\x00" + b"\xff" * (2 * window + 8), np.uint8)
    wanted = np.zeros(len(t), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for s, n in zip(starts.tolist(), counts, strict=True):
        wanted[s : s + n] = True
    sa = suffix_array(t, wanted, window)
    same = common_prefixes(t, sa, window) >= window
    again, first = np.zeros(len(t), bool), np.zeros(len(t), bool)
    again[sa[1:][same]] = True
    again[sa[:-1][same]] = True
    if len(sa):
        first[np.minimum.reduceat(sa, np.flatnonzero(np.concatenate([[True], ~same])))] = True
    return [(again[s : s + n], first[s : s + n]) for s, n in zip(starts.tolist(), counts, strict=True)]


class _Held:
    """Passages to be sorted together. Of segments that are the same bytes two are laid down: a third can't change what repeats."""

    def __init__(self, window: int):
        self.window = window
        self.rows: list[tuple] = []  # shard, doc, tag, start, body to hand on from or None, segments: (number, whether it is the one laid first)
        self.known: dict[bytes, int] = {}
        self.counts: list[int] = []
        self.copies: list[int] = []
        self.size = self.bytes = 0

    def add(self, shard, doc, tag, start, n, cuts, whole, body) -> None:
        parts = []
        for first, last in zip(cuts, [*cuts[1:], n], strict=True):
            piece = body[first : last + self.window - 1]
            k = self.known.setdefault(piece, len(self.counts))
            if k == len(self.counts):
                self.counts.append(last - first)
                self.copies.append(0)
            self.copies[k] += 1
            if self.copies[k] <= 2:
                self.size += last - first
            parts.append((k, self.copies[k] == 1))
        self.rows.append((shard, doc, tag, start, None if whole else body, parts))
        self.bytes += len(body)

    def told(self) -> Iterator[pa.RecordBatch]:
        twice = [k for k, c in enumerate(self.copies) if c > 1]
        pieces = list(self.known)
        found = repeated_windows(pieces + [pieces[k] for k in twice], self.counts + [self.counts[k] for k in twice], self.window)
        gone, on = [], []
        for shard, doc, tag, start, body, parts in self.rows:
            again = np.concatenate([found[k][0] for k, _ in parts])
            if again.any():
                gone.append((doc, tag, ranges_of(again, start)))
            if body is not None:
                first = np.concatenate([found[k][1] if own else np.zeros(self.counts[k], bool) for k, own in parts])
                on += [(doc, tag, shard, start + a, z - a, body[a : z + self.window - 1]) for a, z in runs_of(first).tolist()]
        if gone or on:
            yield found_batch(gone, on)


def _compare(window: int):
    """Shards of passages -> which of their windows occur more than once; of a part of a shard also the first of each kind, to be handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = _Held(window), None
        for b in slices(batches, "body", 1 << 20):
            for s, part, doc, tag, start, n, cuts, whole, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (s, part) != shard and (held.size >= TOGETHER or held.bytes >= 16 * TOGETHER):
                    yield from held.told()
                    held = _Held(window)
                shard = (s, part)
                held.add(s, doc, tag, start, n, cuts, whole, body)
        if held.rows:
            yield from held.told()

    return run


def remove_repeated(docs: DataFrame, least: int = 200, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc, n_units, n_removed, n_spans, kept): texts without the bytes covered by a string of `least` bytes that also starts anywhere else; least is 64 or more. most: bytes of a shard."""
    if least < 64:
        raise ValueError("strings of 64 bytes or more")
    u = Units(window=least, gram=32, block=4096, words=False, most=most)
    rows = numbered(docs, key, text)
    return removed(rows, repeated(rows, u, _compare(least)), u)
