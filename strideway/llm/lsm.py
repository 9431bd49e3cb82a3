"""Exact duplicates by a log-structured merge index.

Each task keeps a memtable of digests; a full one is flushed as a run sorted by digest, one entry
for each digest with the best row so far and a count, so copies shrink before anything is dealt
out. Runs go to buckets of digests; a bucket compacts them by merging, keeping for each digest the
best row (most code points, then smallest identifier). The compacted runs' filters of digests that have
more than one row are united and sent to all tasks: a row that passes none is settled without its text
being moved. Rows that hit are verified by their bytes: texts under one digest are grouped by their normalised bytes, so that a collision
of digests would make groups of its own.

Texts are equal when identical after every blank, tab, line feed, vertical tab, form feed and
return is deleted. Cases: a null text is empty; null keys rank after all others; rows repeated with one key
and group are one document, which stays or goes as a whole; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.llm.common import SPACE, arrow_map, materialise, slices, texts

#: Digests of a memtable.
MEMTABLE = 50_000
#: Rows whose digests make a bucket, at most on average.
BUCKET = 200_000
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Bits for each digest of the filter of those with more than one row, and the most in all (32 MB): beyond, more rows only pass on to the comparison of bytes.
BITS_EACH, MOST_BITS = 16, 1 << 28
LAST = 2**63 - 1

Entry = tuple[bytes, int, int, int]  # digest, minus code points, key, rows


def normal(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def length(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text) if text.isascii() else len(text.decode())


def digest(norm: bytes) -> bytes:
    return hashlib.blake2b(norm, digest_size=16).digest()


class Bloom:
    """A filter of digests: two places each, as digests are evenly spread already."""

    def __init__(self, n: int, bits: int | None = None):
        self.size = bits or max(64, 1 << (12 * max(1, n) - 1).bit_length())
        self.bits = np.zeros(self.size // 8, np.uint8)

    def places(self, digests: list[bytes]) -> np.ndarray:
        both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        return both % np.uint64(self.size)

    def add(self, digests: list[bytes]) -> None:
        at = self.places(digests).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def may_have(self, digests: list[bytes]) -> np.ndarray:
        at = self.places(digests)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def merge(runs: list[list[Entry]]) -> list[Entry]:
    """One sorted run of several: of each digest the smallest (minus code points, key), and the sum of rows."""
    out: list[Entry] = []
    for e in heapq.merge(*runs):
        if out and out[-1][0] == e[0]:
            out[-1] = (*out[-1][:3], out[-1][3] + e[3])
        else:
            out.append(e)
    return out


class Run:
    """Entries sorted by digest, with a filter that is made when first asked for."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.bloom: Bloom | None = None

    def find(self, d: bytes) -> Entry | None:
        if self.bloom is None:
            self.bloom = Bloom(len(self.entries))
            self.bloom.add([e[0] for e in self.entries])
        if not self.bloom.may_have([d])[0]:
            return None
        at = bisect_left(self.entries, d, key=lambda e: e[0])
        return self.entries[at] if at < len(self.entries) and self.entries[at][0] == d else None


class Index:
    """A log-structured merge index of digests, for one task."""

    def __init__(self, memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.memtable, self.fanout = memtable, fanout
        self.recent: dict[bytes, tuple[int, int, int]] = {}
        self.levels: list[list[Run]] = []

    def add(self, d: bytes, minus: int, key: int, rows: int = 1) -> None:
        was = self.recent.get(d)
        self.recent[d] = (minus, key, rows) if was is None else (*min(was[:2], (minus, key)), was[2] + rows)
        if len(self.recent) >= self.memtable:
            self.flush()

    def flush(self) -> None:
        if self.recent:
            self.put(0, sorted((d, *x) for d, x in self.recent.items()))
            self.recent = {}

    def put(self, level: int, run: list[Entry]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(Run(run))
        if len(self.levels[level]) >= self.fanout:
            runs = [r.entries for r in self.levels[level]]
            self.levels[level] = []
            self.put(level + 1, merge(runs))

    def find(self, d: bytes) -> Entry | None:
        """What all that was added has under d; runs whose filter excludes d aren't searched."""
        found = [r for level in self.levels for run in level if (r := run.find(d))]
        if d in self.recent:
            found.append((d, *self.recent[d]))
        return merge([[e] for e in found])[0] if found else None

    def compact(self) -> list[Entry]:
        """All entries as one sorted run."""
        self.flush()
        return merge([r.entries for level in self.levels for r in level])


def _entries(run: list[Entry]) -> pa.RecordBatch:
    d, m, k, n = zip(*run, strict=True) if run else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(m, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["digest", "minus", "key", "n"])


ENTRIES = "digest binary, minus long, key long, n long"


def _batched(run: list[Entry]):
    for at in range(0, len(run), 20_000):
        yield _entries(run[at : at + 20_000])


def _flushed(batches):
    """Sorted runs of at most BUCKET rows of a task, each the merge of its memtables."""
    index, held = Index(), 0
    for b in batches:
        for e in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            index.add(*e)
            held += 1
            if held == BUCKET:
                yield from _batched(index.compact())
                index, held = Index(), 0
    yield from _batched(index.compact())


def _compacted(batches):
    """The runs of a bucket, which come merged by digest: one entry for each, whatever their number."""
    last: Entry | None = None
    for b in batches:
        out = merge([([last] if last else []) + list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))])
        if out:
            last = out.pop()
        yield _entries(out)
    if last:
        yield _entries([last])


def index_of(rows: DataFrame) -> DataFrame:
    """(digest, minus, key, n): the compacted index of rows (digest, minus, key)."""
    spark = rows.sparkSession
    runs = arrow_map(rows.select("digest", "minus", F.coalesce("key", F.lit(LAST)).alias("key"), F.lit(1).cast("long").alias("n")), _flushed, ENTRIES)
    # A bucket's runs are merged by Spark's external sort, and its entries pass one by one.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET))
    return arrow_map(runs.repartition(buckets, "digest").sortWithinPartitions("digest", "minus", "key"), _compacted, ENTRIES)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep, n, kept, digest, sha256) of every row: the key that stays, the group's rows, whether this row stays, and the SHA-256 of its normalised text."""
    if docs.schema[key].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("keys are whole numbers")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def digests(batches):
        for b in slices(batches, "text", 4 << 20):
            raw = texts(b.column(1))
            norm = [normal(t) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([digest(x) for x in norm], pa.binary()), pa.array([-length(t) for t in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in norm], pa.string())],
                ["key", "digest", "minus", "sha256"],
            )

    log = materialise(arrow_map(rows, digests, "key long, digest binary, minus long, sha256 string"), "digest-log")
    index = materialise(index_of(log), "digest-index")
    hits = index.filter("n > 1")
    verified = materialise(_verified(rows, hits), "verified")
    single = log.join(index.filter("n = 1").select("digest"), "digest").select("key", "digest", "sha256", F.col("key").alias("keep"), F.lit(1).cast("long").alias("n"))
    # A group is a digest and, among those that hit, the bytes behind it.
    several = log.join(verified, ["digest", "sha256"]).select("key", "digest", "sha256", F.nullif("best", F.lit(LAST)).alias("keep"), "n")
    out = single.unionByName(several)
    return out.select(F.col("key").alias(key), "keep", "n", F.col("key").eqNullSafe(F.col("keep")).alias("kept"), "digest", "sha256")


def _verified(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """(digest, sha256, best, n) of the groups of equal bytes among rows whose digest hits.

    A filter of bounded size keeps other texts from being dealt out; those it lets through make
    groups that no hit joins. Equal texts are first grouped where they are read."""
    spark = rows.sparkSession
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * hits.count() - 1).bit_length()))

    def fill(batches):
        bloom = Bloom(0, bits)
        for b in batches:
            if b.num_rows:
                bloom.add(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([bloom.bits.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for r in arrow_map(hits.select("digest").coalesce(8), fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(total)  # MOST_BITS / 8 bytes at most

    def candidates(batches):
        bloom = Bloom(0, bits)
        bloom.bits = sent.value
        for b in slices(batches, "text", 4 << 20):
            raw = texts(b.column(1))
            norm = [normal(t) for t in raw]
            names = [digest(x) for x in norm]
            some = np.flatnonzero(bloom.may_have(names))
            # digest -> the distinct bytes met under it in this batch, each with its best row and count
            met: dict[tuple[bytes, bytes], list[int]] = {}
            keys = b.column(0).to_pylist()
            for i in some.tolist():
                k = LAST if keys[i] is None else keys[i]
                m = -length(raw[i])
                was = met.setdefault((names[i], norm[i]), [m, k, 0])
                was[0], was[1] = min((was[0], was[1]), (m, k))
                was[2] += 1
            if met:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in met], pa.binary()), pa.array([x[1] for x in met], pa.binary()), *(pa.array([v[i] for v in met.values()], pa.int64()) for i in range(3))],
                    ["digest", "bytes", "minus", "key", "n"],
                )

    local = arrow_map(rows, candidates, "digest binary, bytes binary, minus long, key long, n long")
    whole = local.join(hits.select("digest"), "digest", "left_semi")
    same = whole.groupBy("digest", "bytes").agg(F.min(F.struct("minus", "key")).alias("best"), F.sum("n").alias("n"))
    return same.select("digest", F.sha2("bytes", 256).alias("sha256"), F.col("best.key").alias("best"), "n")


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, as they are; of rows that share key and normalised text the longest one."""
    mark = "__lsm_sha256"
    marked = docs.withColumn(mark, F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256))
    kept = materialise(exact_groups(docs, key, text).filter("kept").groupBy(F.col(key).alias("_key"), F.col("sha256").alias("_sha")).agg(F.count("*").alias("_rows")), "kept")
    same = marked[mark].eqNullSafe(kept["_sha"]) & marked[key].eqNullSafe(kept["_key"])
    out = marked.join(kept, same, "left_semi")
    again = kept.filter("_rows > 1")
    if not again.isEmpty():
        twice = marked[mark].eqNullSafe(again["_sha"]) & marked[key].eqNullSafe(again["_key"])
        first = Window.partitionBy(key, mark).orderBy(F.length(text).desc(), F.col(text))
        few = marked.join(again, twice, "left_semi").withColumn("__lsm_rank", F.row_number().over(first)).filter("__lsm_rank = 1").drop("__lsm_rank")
        out = out.join(again, twice, "left_anti").unionByName(few)
    return out.drop(mark)
