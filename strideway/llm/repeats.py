"""Windows that repeat anywhere in a corpus: how texts are cut up and sent where repeats can meet.

Shared by the removal of repeated word passages (suffix automata) and of repeated byte strings
(suffix arrays), which decide what repeats; here is only decided where passages meet.

1. Every text is cut into segments (see minimizers); a window can only repeat where its segment's
   key does. Keys that occur once, and not twice inside their segment, end here.
2. A key's shard is the block, in the first document that has it, in which it first stands. Neighbouring
   segments of a copy so stay together: they travel as one passage, once, to the shard they share.
   A block whose keys have more than `most` units in all is a shard for each of its keys.
3. A shard of at most `most` units is compared by one task. A larger one, as a passage that a third of all documents
   share makes, is dealt out to parts by document. A part is compared like any shard; besides what repeats in
   it, it hands on one occurrence (the first) of each different window. So copies shrink to one for each part.
   What is handed on is cut anew by another order of hashes, which sets apart what texts share from what is their
   own, and goes through 3 again with a shard for each old one and new key. What LEVELS cuts haven't told
   apart is dealt out window by window.
4. What is to go returns to its document as ranges of window starts.

Hashes only route: whatever goes has been found equal by an automaton or a suffix array. Texts are
dealt out by document twice, compressed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.llm import minimizers as M
from strideway.llm.common import arrow_map, materialise, raw_bytes, slices, texts

#: Cuts by a new order of hashes.
LEVELS = 6
LAST = 2**63 - 1


@dataclass(frozen=True)
class Units:
    """What texts are made of. block: units of a block of the first document; most: units of a shard that one task compares."""

    window: int
    gram: int
    block: int
    words: bool
    most: int

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """First byte of every unit, and the byte after; None where units are bytes."""
        return word_edges(np.frombuffer(text, np.uint8)) if self.words else None


def between(text: bytes, edges, first: int, last: int) -> bytes:
    """Units first to last - 1 of a text."""
    return text[first:last] if edges is None else text[edges[0][first] : edges[1][last - 1]]


def word_edges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, its first byte, the byte after it) in bytes that hold no other text."""
    starts, ends = word_edges(b)
    step, back = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * step[: len(b)])])
    return M.mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts, ends


_POWERS: list = [np.empty(0, np.uint64)] * 2


def powers(n: int):
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, r in enumerate((0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))):
            x = np.full(size, r, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS


def _pieces(b: pa.RecordBatch, u: Units):
    """(rows, unit hashes' grams, bounds, first unit of each row) of parts of a batch, none of them long; a long text comes in overlapping parts."""
    for part in slices(iter([b]), "text", M.PIECE // 2):
        data, off = raw_bytes(part.column(part.schema.get_field_index("text")))
        if part.num_rows == 1 and len(data) > M.PIECE:
            yield from _long(data, u, part)
        elif u.words:
            # A blank between texts keeps their words apart.
            joined = np.insert(data, off[1:], 32)
            h, starts, _ = word_hashes(joined)
            bounds = starts.searchsorted(off + np.arange(len(off)))
            yield part, M.doubled(h, u.gram), bounds, np.zeros(part.num_rows, np.int64)
        else:
            yield part, M.byte_hashes(data, u.gram), off, np.zeros(part.num_rows, np.int64)


def _long(data: np.ndarray, u: Units, part: pa.RecordBatch):
    if not u.words:
        for at in range(0, max(1, len(data) - u.window + 1), M.PIECE):
            some = data[at : at + M.PIECE + u.window - 1]
            yield part, M.byte_hashes(some, u.gram), np.asarray([0, len(some)]), np.asarray([at])
        return
    # Words never reach over a cut made at a blank; their hashes are small enough to keep whole.
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + M.PIECE)
        blank = np.flatnonzero((data[at:end] == 32) | ((data[at:end] >= 9) & (data[at:end] <= 13)))
        if end < len(data):
            end = at + int(blank[-1]) + 1 if len(blank) else len(data)
        found.append(word_hashes(data[at:end])[0])
        at = end
    h = np.concatenate(found)
    for at in range(0, max(1, len(h) - u.window + 1), M.PIECE):
        some = h[at : at + M.PIECE + u.window - 1]
        yield part, M.doubled(some, u.gram), np.asarray([0, len(some)]), np.asarray([at])


def _segments(u: Units):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            for part, grams, bounds, first in _pieces(b, u):
                s = M.segments(grams, bounds, u.window, u.gram)
                row = bounds.searchsorted(s.start, "right") - 1
                at = s.start - bounds[row] + first[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at), pa.array(s.n), pa.array(s.key), pa.array(s.multi)], ["doc", "tag", "start", "n", "key", "multi"])

    return run


CUT = "doc long, tag long, start long, n long, key long, multi boolean"


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tag, text): tag tells apart rows that share a key, which only then are written down with a number of their own."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    if again.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("tag"), "text")
    return materialise(rows.withColumn("tag", F.monotonically_increasing_id()).select("doc", "tag", "text"), "numbered")


def packed(rows: DataFrame) -> DataFrame:
    """(doc, tag, z, size): texts compressed, and their bytes before."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, "text", 4 << 20):
            raw = texts(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(t) for t in raw], pa.binary()), pa.array([len(t) for t in raw], pa.int64())], ["doc", "tag", "z", "size"])

    return arrow_map(rows, run, "doc long, tag long, z binary, size long")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _passages(u: Units):
    """Runs of a document's segments that go to one shard."""

    def run(batches):
        for b in slices(batches, "size", 2 << 20):
            segs, parts = b.column(4).flatten(), np.diff(b.column(4).offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), parts)
            start, n, shard, total = (segs.field(i).to_numpy() for i in range(4))
            order = np.lexsort((start, row))
            row, start, n, shard, total = (x[order] for x in (row, start, n, shard, total))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (shard[1:] != shard[:-1])
            first = np.flatnonzero(new)
            past = np.append(first[1:], len(row))
            runs = list(zip(row[first].tolist(), start[first].tolist(), (start[past - 1] + n[past - 1]).tolist(), strict=True))
            bodies, at = [], -1
            for r, a, z in runs:
                if r != at:
                    at, text = r, unpacked(b.column(2)[r].as_py())
                    edges = u.edges(text)
                bodies.append(between(text, edges, a, z + u.window - 1))
            take = pa.array(row[first])
            cuts = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(start - np.repeat(start[first], past - first)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[first]), pa.array(total[first]), b.column(0).take(take), b.column(1).take(take), pa.array(start[first]), pa.array([z - a for _, a, z in runs], pa.int64()), cuts, pa.array(bodies, pa.binary())],
                ["shard", "total", "doc", "tag", "start", "n", "cuts", "body"],
            )

    return run


PASSAGES = "shard long, total long, doc long, tag long, start long, n long, cuts array<long>, body binary"
#: What a comparison gets, dealt out by shard and part and in order within it: cuts are the starts of a passage's segments; whether the part is the whole shard.
SHARDED = ["shard", "part", "doc", "tag", "start", "n", "cuts", "whole", "body"]
#: What a comparison gives: windows of a document that are to go (spans), or a run of windows to hand on (shard, start, n, body).
FOUND = "doc long, tag long, spans binary, shard long, start long, n long, body binary"


def found_batch(gone: list[tuple], on: list[tuple]) -> pa.RecordBatch:
    """gone: (doc, tag, spans); on: (doc, tag, shard, start, n, body)."""
    rows = [(d, t, s, None, None, None, None) for d, t, s in gone] + [(d, t, None, *x) for d, t, *x in on]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc", "tag", "spans", "shard", "start", "n", "body"])


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Runs of set flags as rows (first, past the last)."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).reshape(-1, 2)


def ranges_of(flags: np.ndarray, start: int = 0) -> bytes:
    """runs_of() as little-endian longs."""
    return (runs_of(flags) + start).astype("<i8").tobytes()


def _grams(u: Units, column: pa.Array):
    """(bytes laid end to end, edges or None, grams, bounds) of bodies."""
    data, off = raw_bytes(column)
    if not u.words:
        return data, None, M.byte_hashes(data, u.gram), off
    data = np.insert(data, off[1:], 32)
    h, starts, ends = word_hashes(data)
    return data, (starts, ends), M.doubled(h, u.gram), starts.searchsorted(off + np.arange(len(off)))


CUT_ANEW = "shard long, doc long, tag long, start long, n long, body binary, multi boolean"


def _cut_rows(b: pa.RecordBatch, u: Units, data, edges, bounds, at, n, key, multi) -> pa.RecordBatch:
    """Segments (first unit at, n windows) of a batch (doc, tag, shard, start, n, body); a new shard holds what an old one and a key have in common."""
    row = bounds.searchsorted(at, "right") - 1
    raw = data.tobytes()
    old = b.column(2).to_numpy()[row]
    shard = M.mixed(old.view(np.uint64) * M.C + key.view(np.uint64)).view(np.int64)
    bodies = [between(raw, edges, i, i + k + u.window - 1) for i, k in zip(at.tolist(), n.tolist(), strict=True)]
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard), b.column(0).take(take), b.column(1).take(take), pa.array(b.column(3).to_numpy()[row] + at - bounds[row]), pa.array(n), pa.array(bodies, pa.binary()), pa.array(multi)],
        ["shard", "doc", "tag", "start", "n", "body", "multi"],
    )


def _recut(u: Units, level: int):
    """Segments of passages by another order of hashes."""
    salt = M.mixed(np.asarray([level], np.uint64))[0]

    def run(batches):
        for b in slices(batches, "body", 1 << 19):
            data, edges, grams, bounds = _grams(u, b.column(5))
            s = M.segments(M.mixed(grams ^ salt), bounds, u.window, u.gram)
            yield _cut_rows(b, u, data, edges, bounds, s.start, s.n, s.key, s.multi)

    return run


def _windows(u: Units):
    """Every window of passages by itself."""
    offs = [*range(0, u.window - u.gram, u.gram), u.window - u.gram]

    def run(batches):
        for b in slices(batches, "body", 1 << 15):
            data, edges, grams, bounds = _grams(u, b.column(5))
            count = b.column(4).to_numpy()
            at = np.repeat(bounds[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
            key = np.zeros(len(at), np.uint64)
            for o in offs:
                key = M.mixed(key * M.C + grams[at + o])
            yield _cut_rows(b, u, data, edges, bounds, at, np.ones(len(at), np.int64), key.view(np.int64), np.zeros(len(at), bool))

    return run


def _compared(rows: DataFrame, u: Units, compare: Callable) -> DataFrame:
    """FOUND of rows (shard, total, doc, tag, start, n, cuts, body); total: the shard's units, about."""
    spark = rows.sparkSession
    parts = F.ceil(F.col("total") / u.most)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc", "tag"), parts)).withColumn("whole", parts == 1).select(*SHARDED)
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    return materialise(arrow_map(dealt.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "doc", "tag", "start"), compare, FOUND), "compared")


def sharded(segs: DataFrame, u: Units) -> DataFrame:
    """(key, shard, total) of the keys that may repeat: total units of the shard, about. segs: CUT."""
    size = F.col("n") + (u.window - 1)
    keys = segs.groupBy("key").agg(F.count("*").alias("c"), F.max("multi").alias("m"), F.sum(size).alias("size"), F.min(F.struct("doc", "tag", "start")).alias("first")).filter("c > 1 or m")
    block = F.xxhash64("first.doc", "first.tag", F.floor(F.col("first.start") / u.block))
    # A block has no more keys than units.
    told = keys.withColumn("block", block).withColumn("all", F.sum("size").over(Window.partitionBy("block")))
    own = F.col("all") > u.most
    return told.select("key", F.when(own, F.xxhash64("key", "block")).otherwise(F.col("block")).alias("shard"), F.when(own, F.col("size")).otherwise(F.col("all")).alias("total"))


def repeated(rows: DataFrame, u: Units, compare: Callable) -> DataFrame:
    """(doc, tag, spans): ranges of the starts of windows that are to go. rows: numbered(). compare: from an iterator of SHARDED batches to FOUND ones."""
    segs = materialise(arrow_map(rows, _segments(u), CUT), "segments")
    # Written down, so that the join has an exchange on both sides and a common key's part can be split.
    known = materialise(sharded(segs, u), "keys")
    found = segs.join(known, "key").select("doc", "tag", F.struct("start", "n", "shard", "total").alias("s"))
    by_doc = found.groupBy("doc", "tag").agg(F.collect_list("s").alias("segs"))  # no more than a document's own
    with_text = packed(rows).join(by_doc, ["doc", "tag"]).select("doc", "tag", "z", "size", "segs")
    passages = materialise(arrow_map(with_text, _passages(u), PASSAGES), "passages")
    out = [_compared(passages, u, compare)]
    for level in range(1, LEVELS + 2):
        left = out[-1].filter("body is not null").select("doc", "tag", "shard", "start", "n", "body")
        if left.isEmpty():
            break
        cut = materialise(arrow_map(left, _recut(u, level) if level <= LEVELS else _windows(u), CUT_ANEW), "cut-anew")
        size = F.col("n") + (u.window - 1)
        sizes = materialise(cut.groupBy("shard").agg(F.count("*").alias("c"), F.max("multi").alias("m"), F.sum(size).alias("total")).filter("c > 1 or m").select("shard", "total"), "sizes")
        # Of equal windows, which are all that a last shard has, a comparison holds one or two, whatever their number.
        total = F.col("total") if level <= LEVELS else F.lit(1)
        out.append(_compared(cut.join(sizes, "shard").withColumn("cuts", F.array(F.lit(0).cast("long"))).withColumn("total", total), u, compare))
    spans = reduce(DataFrame.unionByName, [x.filter("spans is not null").select("doc", "tag", "spans") for x in out])
    return materialise(spans.groupBy("doc", "tag").agg(F.collect_list("spans").alias("spans")), "spans")


def covered(spans: list[bytes] | None, n: int, window: int) -> np.ndarray:
    """Which of n units a window that is to go covers."""
    if not spans:
        return np.zeros(n, bool)
    pairs = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, pairs[:, 1] - 1 + window, -1)
    return steps[:n].cumsum() > 0


def remaining(text: bytes, edges, gone: np.ndarray) -> bytes:
    """What is left of a text; words are joined by a blank."""
    data = np.frombuffer(text + b" ", np.uint8).copy()
    if edges is None:
        return data[:-1][~gone].tobytes() if gone.any() else text
    starts, ends = edges[0][~gone], edges[1][~gone]
    data[ends] = 32  # a word goes with the byte after it
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] = 1
    step[ends + 1] -= 1
    return data[step[:-1].cumsum(dtype=np.int8) > 0][:-1].tobytes()


def removed(rows: DataFrame, spans: DataFrame, u: Units) -> DataFrame:
    """(doc, n_units, n_removed, n_spans, kept) of every row."""
    joined = packed(rows).join(spans, ["doc", "tag"], "left").select("doc", "z", "size", "spans")

    def run(batches):
        for b in slices(batches, "size", 2 << 20):
            n_units, n_removed, n_spans, kept = [], [], [], []
            for row in range(b.num_rows):
                text, found = unpacked(b.column(1)[row].as_py()), b.column(3)[row].as_py()
                edges = u.edges(text)
                gone = covered(found, len(text) if edges is None else len(edges[0]), u.window)
                n_units.append(len(gone))
                n_removed.append(int(gone.sum()))
                n_spans.append(len(runs_of(gone)))
                kept.append(remaining(text, edges, gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc", "n_units", "n_removed", "n_spans", "kept"])

    out = arrow_map(joined, run, "doc long, n_units long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc", F.nullif("doc", F.lit(LAST)))
