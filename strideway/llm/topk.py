"""Exact top-k search by distributed histogram selection.

Scores are inner products of whole-number vectors. Candidates are dealt out to groups of bounded
size; every query visits every group, where all its scores are counted by bin. The sums over all groups tell in
which bin each query's k-th best score lies. That bin becomes the next round's range, until a bin is
one score wide. A last pass keeps what scores better, and of those that score just as much the smallest keys.

All queries are refined in the same round, so the number of rounds depends on the largest score alone, and
nothing but that goes to the driver. A group sends, for each query, the bins down to its own k-th best
only: the k-th best of all lies no lower. A task holds one group and a block of queries. Work is
that of a scan of all rows by each query, as an exact search has it.

Cases: vectors that are null or hold null or non-finite components take no part, nor do those
without a key; a query meets vectors of its own length only; rows that share the query's key are its own; a key
repeated among queries counts once, with its smallest vector, while repeated candidates count
each; with fewer than k candidates all are returned; scores beyond a long are cut to its range; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.llm.common import arrow_map, materialise

#: Queries and candidates that a task compares at once, at most; bins of a round; scores held at once.
BLOCK, GROUP, BINS = 2048, 1 << 17, 1024
AT_ONCE = 1 << 20
LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, or null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


@dataclass(frozen=True)
class Plan:
    """What all tasks know: no score is beyond bound either way; widths of a bin, round by round."""

    k: int
    bound: int
    block: int

    @property
    def kind(self) -> type:
        return np.float32 if self.bound < 2**24 else np.float64 if self.bound < 2**53 else object

    @property
    def widths(self) -> list[int]:
        out = [-(-(2 * self.bound + 1) // BINS)]
        while out[-1] > 1:
            out.append(-(-out[-1] // BINS))
        return out

    def low(self, bins: list[int] | None) -> int:
        """The lowest score of the range that the bins found so far lead to; without a k-th best, one below all."""
        return -self.bound - 1 if bins is None else -self.bound + sum(b * w for b, w in zip(bins, self.widths, strict=False))


def met(plan: Plan, batches: Iterator[pa.RecordBatch]):
    """Of each group, blocks of queries with parts of the candidates: (dims, query keys, bins found, low, candidate keys, scores). A query's own rows score below all."""
    at, keys, vectors = None, [], []
    for b in batches:
        dims, group, kind = (b.column(i).to_numpy() for i in range(3))
        turn = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])])) if b.num_rows else []
        for first, last in zip(turn, [*turn[1:], b.num_rows], strict=True):
            part = b.slice(first, last - first)
            if (dims[first], group[first]) != at:
                at, keys, vectors = (dims[first], group[first]), [], []
            v = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(plan.kind)
            if kind[first] == 0:  # candidates come first
                keys.append(part.column(3).to_numpy())
                vectors.append(v)
                continue
            if len(keys) > 1:
                keys, vectors = [np.concatenate(keys)], [np.concatenate(vectors)]
            for start in range(0, part.num_rows if keys else 0, plan.block):
                asked = part.slice(start, plan.block)
                own, left = asked.column(3).to_numpy(), v[start : start + plan.block]
                bins = asked.column(5).to_pylist()
                low = np.asarray([plan.low(x) for x in bins], object if plan.kind is object else np.int64)
                step = max(1, AT_ONCE // len(own))
                order = np.argsort(own, kind="stable")
                yield int(dims[first]), own, low, _scores(plan, own, left, order, keys[0], vectors[0], step)


def _scores(plan: Plan, own, left, order, keys, vectors, step):
    for c in range(0, len(keys), step):
        some = keys[c : c + step]
        s = left @ vectors[c : c + step].T
        if plan.kind is not object:
            s = s.astype(np.int64)
        place = own[order].searchsorted(some)
        hit = np.flatnonzero((place < len(own)) & (own[order][np.minimum(place, len(own) - 1)] == some))
        s[order[place[hit]], hit] = -plan.bound - 2
        yield some, s


def counted(plan: Plan, turn: int, batches):
    width = plan.widths[turn]
    span = width * BINS if turn == 0 else plan.widths[turn - 1]
    for dims, own, low, parts in met(plan, batches):
        counts = np.zeros((len(own), BINS), np.int64)
        for _, s in parts:
            past = s - low[:, None]
            q, j = np.nonzero((past >= 0) & (past < span))
            bins = (past[q, j] // width).astype(np.int64)
            counts += np.bincount(q * BINS + bins, minlength=counts.size).reshape(counts.shape)
        better = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        q, j = np.nonzero((counts > 0) & (better < plan.k))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), dims, np.int32)), pa.array(own[q]), pa.array(j.astype(np.int32)), pa.array(counts[q, j])], ["dims", "key", "bin", "n"])


def chosen(plan: Plan, batches):
    """Scores above the k-th best (low) and, of those equal to it, a group's k smallest keys for each query."""

    def rows(dims, own, q, keys, scores):
        cut = [max(-LONG - 1, min(LONG, int(x))) for x in scores] if plan.kind is object else scores
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), dims, np.int32)), pa.array(own[q]), pa.array(keys), pa.array(cut, pa.int64())], ["dims", "query_id", "key", "score"])

    for dims, own, low, parts in met(plan, batches):
        tied_q, tied_key = np.empty(0, np.int64), np.empty(0, np.int64)
        for keys, s in parts:
            q, j = np.nonzero((s > low[:, None]) & (s >= -plan.bound))
            yield rows(dims, own, q, keys[j], s[q, j])
            q, j = np.nonzero((s == low[:, None]) & (s >= -plan.bound))
            tied_q, tied_key = np.concatenate([tied_q, q]), np.concatenate([tied_key, keys[j]])
            order = np.lexsort((tied_key, tied_q))
            tied_q, tied_key = tied_q[order], tied_key[order]
            place = np.arange(len(tied_q)) - tied_q.searchsorted(tied_q)
            tied_q, tied_key = tied_q[place < plan.k], tied_key[place < plan.k]
        yield rows(dims, own, tied_q, tied_key, low[tied_q])


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, score): for each row that is_query marks, its k best among all other rows. group, block: candidates and queries that a task compares at once."""
    spark = vectors.sparkSession
    kept = vectors.withColumn("__v", quantised(F.col(vector), scale)).filter(F.col("__v").isNotNull() & F.col(key).isNotNull())
    rows = materialise(kept.select(F.size("__v").alias("dims"), F.col(key).cast("long").alias("key"), F.col("__v").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")), "vectors")
    size = lambda v: F.aggregate(F.transform(v, lambda x: F.abs(x).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    top = rows.agg(F.count("*").alias("n"), F.max(F.when(F.col("asked"), size("v"))).alias("sum"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("decimal(38,0)")))).alias("one")).first()
    plan = Plan(k, max(1, int(top["sum"] or 0) * int(top["one"] or 0)), block)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-top.n // group))
    candidates = rows.select("dims", F.pmod(F.xxhash64("key", "v"), F.lit(parts)).cast("int").alias("group"), F.lit(0).alias("kind"), "key", "v", F.lit(None).cast("array<int>").alias("bins"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("group")
    queries = rows.filter("asked").groupBy("key").agg(F.min("v").alias("v")).select(F.size("v").alias("dims"), "key", "v").withColumns({"bins": F.array().cast("array<int>"), "above": F.lit(0).cast("long")})
    queries = materialise(queries, "queries")

    def visits(asked: DataFrame) -> DataFrame:
        """All groups, each with every query: candidates first."""
        sent = asked.select("dims", groups, F.lit(1).alias("kind"), "key", "v", "bins")
        return candidates.unionByName(sent).repartition(parts, "group").sortWithinPartitions("group", "dims", "kind").select("dims", "group", "kind", "key", "v", "bins")

    down = Window.partitionBy("dims", "key").orderBy(F.col("bin").desc())
    for turn in range(len(plan.widths)):
        live = queries.filter("bins is not null")
        hist = arrow_map(visits(live), lambda b, turn=turn: counted(plan, turn, b), "dims int, key long, bin int, n long").groupBy("dims", "key", "bin").agg(F.sum("n").alias("n"))
        reach = hist.withColumn("upto", F.sum("n").over(down)).join(live.select("dims", "key", "above"), ["dims", "key"]).filter(F.col("above") + F.col("upto") >= k)
        found = reach.groupBy("dims", "key").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("before")), "bin").alias("x"))
        # A query without a k-th best has no bin in the first round, and then takes all.
        told = queries.join(found, ["dims", "key"], "left").select("dims", "key", "v", F.when(F.col("x").isNotNull(), F.concat("bins", F.array("x.bin"))).alias("bins"), (F.col("above") + F.coalesce("x.before", F.lit(0))).alias("above"))
        queries = materialise(told, "queries")
    hits = arrow_map(visits(queries), lambda b: chosen(plan, b), "dims int, query_id long, key long, score long")
    first = Window.partitionBy("dims", "query_id").orderBy(F.col("score").desc(), "key")
    return hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
