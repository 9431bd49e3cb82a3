"""Near copies by exact Jaccard similarity of word shingles.

Texts are sets of hashed runs of five words. Candidates share all of a band of four minimum hashes
in one of 24 bands: a pair of similarity 0.8 shares none with a chance of 3 in a million, one of 0.9
of 1 in 10^11. Candidates are linked by stars and put together; in such a group the similarity of
texts is counted out on their sets, breadth first from each text to those not yet reached. So
components are those of all verified pairs among candidates, and near copies, reached in a few steps,
don't take the square of their number. A group of more than TILE texts is cut into tiles; each pair of
tiles is verified by a task of its own, and the stars found are put together again.

Cases: words are parted and lower-cased as for SimHash; a text of fewer words is one shingle; texts
without words are one group; a null key is never what stays unless there is no other; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import arrow_map, materialise, row_id, rows_of, slices, texts
from strideway.llm.links import components

WIDTH, LEAST = 5, 0.8
#: Different texts of a tile, on average.
TILE = 4096
BANDS, BAND_ROWS = 24, 4
ODD = np.random.default_rng(5).integers(0, 2**63, (2, BANDS * BAND_ROWS)).astype(np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the runs of width words, sorted."""
    words = text.lower().split()
    w = min(width, len(words))
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - w + 1
    out = np.zeros(n, np.uint64)
    for i in range(w):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS): a hash of each band of minimum hashes. No set is empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for i in range(BANDS * BAND_ROWS):
        x = (flat ^ ODD[0, i]) * ODD[1, i]
        x ^= x >> np.uint64(32)
        low = np.minimum.reduceat(x * np.uint64(0xD6E8FEB86659FD93), starts)
        at = i // BAND_ROWS
        out[:, at] = (out[:, at] ^ low ^ np.uint64(at)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, at] ^= out[:, at] >> np.uint64(31)
    return out


def linked(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set the first set of its component, where sets whose Jaccard similarity is least or more are linked."""
    sizes = np.asarray([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    root = np.full(len(sets), -1)
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    left = np.arange(len(sets))
    while len(left):
        first, left = left[0], left[1:]
        root[first], queue = first, [first]
        while queue and len(left):
            at = queue.pop()
            fit = left[(sizes[left] >= least * sizes[at] - 1) & (sizes[at] >= least * sizes[left] - 1)]
            if not len(fit):
                continue
            mark[parts[at]] = True
            both = np.add.reduceat(mark[np.concatenate([parts[i] for i in fit])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[fit])[:-1]]))
            mark[parts[at]] = False
            near = fit[both >= least * (sizes[at] + sizes[fit] - both) - 1e-9]
            root[near] = first
            queue.extend(near.tolist())
            left = left[root[left] < 0]
    return root


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, root) of every row: node is a digest of its words, root one node of its component."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def node_of(t: bytes) -> str:
        return hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).hexdigest()

    def sign(batches):
        for b in slices(batches, "text", 1 << 20):
            raw = texts(b.column(1))
            sets = [shingles(t) for t in raw]
            some = [i for i, s in enumerate(sets) if len(s)]
            found: list = [None] * len(raw)
            for i, x in zip(some, bands([sets[i] for i in some]).view(np.int64) if some else (), strict=True):
                found[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([node_of(t) for t in raw]), pa.array(found, pa.list_(pa.int64()))], ["key", "node", "bands"])

    signed = materialise(arrow_map(rows, sign, f"key {kind}, node string, bands array<long>"), "bands")
    spread = signed.select("node", F.explode("bands").alias("band"))
    # Copies are put together where they are read; of a band only its smallest node goes on.
    lows = spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("band", "low")
    top = components(spread.join(lows, "band").filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")))
    members = materialise(top.select(F.col("u").alias("at"), F.col("v").alias("meets")).unionByName(top.select(F.col("v").alias("at"), F.col("v").alias("meets")).distinct()), "candidates")

    def named(batches):
        for b in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in texts(b.column(0))]), b.column(0)], ["at", "text"])

    # The groups of more than a tile, with their tiles; most have one, which meets itself.
    large = materialise(members.groupBy("meets").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).filter("tiles > 1"), "large-groups")
    tiled = members.join(large, "meets", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("at"), F.col("tiles")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.least(i, "own").alias("p"), F.greatest(i, "own").alias("q")))).alias("pair")
    placed = tiled.select("at", "meets", pairs).select("at", F.concat_ws("|", "meets", "pair.p", "pair.q").alias("meets"))
    held = arrow_map(rows.select("text"), named, "at string, text string").join(placed, "at")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = held.select("meets", "at", "text").repartition(parts, "meets").sortWithinPartitions("meets", "at")

    def verify(batches):
        def settle(names, sets):
            root = linked(sets)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in moved], pa.string()), pa.array([names[root[i]] for i in moved], pa.string())], ["at", "root"])

        group, names, sets = None, [], []
        for b in slices(batches, "text", 1 << 20):
            for g, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                if g != group:
                    if len(names) > 1:
                        yield settle(names, sets)
                    group, names, sets = g, [], []
                if not names or names[-1] != n:
                    names.append(n)
                    sets.append(shingles(t))
        if len(names) > 1:
            yield settle(names, sets)

    verified = materialise(arrow_map(dealt, verify, "at string, root string"), "verified-links")
    if not large.isEmpty():
        verified = components(verified.select(F.col("at").alias("u"), F.col("root").alias("v"))).select(F.col("u").alias("at"), F.col("v").alias("root"))
    return signed.join(verified, F.col("node") == F.col("at"), "left").select(F.col("key").alias(key), "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group the row with the smallest key, as it is; one without a key only where the group has none.

    Of rows that share that key, the one whose text has the smallest digest stays, and rows that share the text too stay all."""
    groups = near_groups(docs.select(row_id(key, text).alias("id"), F.col(text).alias("text")), "id", "text")
    kept = groups.groupBy("root").agg(F.min("id").alias("id")).select("id").distinct()
    return rows_of(docs, materialise(kept, "kept"), key, text)
