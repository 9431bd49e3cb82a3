"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are put into cells by the population counts of their four 16-bit parts. Two
fingerprints within the radius differ by no more than the radius in the sum of those counts'
differences, so whole tiles of cells farther apart are skipped without loss; tiles that remain are
compared in numpy by exclusive-or and bit count. Of the links found in a pair of tiles a spanning
star for each component goes on: components are the same and a group of near copies doesn't grow
with its square. Copies with one fingerprint count as one node.

Cases: a null or empty text has no words and fingerprint 0, which links like any other; a null key
takes part but is never a component's id unless there is no other; repeated rows share a
fingerprint; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import arrow_map, materialise, row_id, rows_of, slices, texts
from strideway.llm.links import components, stars

PARTS = 4
#: Fingerprints of a tile, about: 64 KB.
TILE = 8192
#: Rows of a tile that are compared at once with the other tile.
STRIP = 64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(width, len(words))
    h = xxhash.xxh64_digest
    raw = b"".join([h(norm[a:b], seed) for a, b in zip(starts[: len(starts) - w + 1].tolist(), ends[w - 1 :].tolist(), strict=True)])
    n = len(raw) // 8
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4080):  # sums of 255 rows fit a byte
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, min(4080, n - at) * 8, at * 8)).reshape(-1, 64)
        full = len(bits) // 255 * 255
        if full:
            counts += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[full:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the 64 bits as a signed long."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for b in slices(batches, "text", 1 << 20):
            fps = np.asarray([fingerprint(t, width, seed) for t in texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return arrow_map(rows, run, f"key {docs.schema[key].dataType.simpleString()}, fp long")


def close(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links between tiles a and b (the same tile if same)."""
    x, y = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for at in range(0, len(a), STRIP):
        part = a[at : at + STRIP]
        other = b[at:] if same else b
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
        if len(i):
            found = part[i] != other[j]
            x, y = stars(np.concatenate([x, part[i[found]]]), np.concatenate([y, other[j[found]]]))
    return x, y


def steps_to(radius: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius, of each pair of opposites one."""
    found = [()]
    for _ in range(parts):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f >= (0,) * parts]


def near_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints with the components of all pairs within the radius. fps: (fp), distinct."""
    spark = fps.sparkSession
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(PARTS)]
    code = sum((c * 17**i for i, c in enumerate(counts)), F.lit(0))
    celled = fps.select("fp", code.cast("int").alias("cell"))
    # One row for each of at most 17^4 cells, whatever the number of fingerprints.
    sizes = materialise(celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")), "cells")
    tiled = celled.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    packed = materialise(tiled.groupBy("cell", "chunk").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")
    steps = steps_to(radius)
    near = F.array(*[F.struct(F.lit(sum(d * 17**i for i, d in enumerate(s))).alias("by"), *[F.lit(d).alias(f"d{i}") for i, d in enumerate(s)]) for s in steps])
    # A tile visits the home tiles of the cells near its own; each pair of cells meets once.
    visits = packed.select("cell", "chunk", "fps", F.explode(near).alias("to"))
    for i in range(PARTS):
        at = F.pmod(F.floor(F.col("cell") / 17**i), F.lit(17)) + F.col(f"to.d{i}")
        visits = visits.filter((at >= 0) & (at <= 16))
    homes = F.broadcast(sizes.select(F.col("cell").alias("home"), F.col("chunks").alias("home_chunks")))
    visits = (
        visits.withColumn("home", F.col("cell") + F.col("to.by"))
        .join(homes, "home")
        .select("home", F.explode(F.expr("sequence(0, home_chunks - 1)")).alias("home_chunk"), "cell", "chunk", "fps")
        .filter("home <> cell or home_chunk <= chunk")
        .withColumn("first", (F.col("home") != F.col("cell")) | (F.col("home_chunk") != F.col("chunk")))
    )
    dealt = visits.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 2), "home", "home_chunk").sortWithinPartitions("home", "home_chunk", "first", "cell", "chunk").select("home", "home_chunk", "first", "fps")

    def run(batches):
        home, own = None, np.empty(0, np.uint64)
        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for row, (h, c, first) in enumerate(ids):
                got = b.column(3).slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                if not first:  # false sorts before true: the home tile itself comes first, if any fingerprint fell into it
                    home, own = (h, c), got
                if home == (h, c):
                    x, y = close(own, got, radius, not first)
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["u", "v"])

    return arrow_map(dealt, run, "u long, v long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """(key, fp, component): component is the smallest key that links reach, the row's own included."""
    rows = materialise(fingerprints(docs, key, text, width, seed), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("key").alias("low"))
    top = components(near_links(nodes.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(top, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    classes = materialise(rooted.join(lows, "root").select("fp", "component"), "classes")
    return rows.join(classes, "fp").select(F.col("key").alias(key), "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Of each group the row with the smallest key, as it is; one without a key only where the group has none.

    Of rows that share that key, the one whose text has the smallest digest stays, and rows that share the text too stay all."""
    groups = near_groups(docs.select(row_id(key, text).alias("id"), F.col(text).alias("text")), "id", "text", **kw)
    return rows_of(docs, groups.filter("id = component").select("id").distinct(), key, text)
