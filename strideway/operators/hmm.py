"""Hidden Markov smoothing: parameters by aggregation, decoding by a scan over each group."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.session import written

TINY = 1e-16
#: States of a chain, at most: tables of labels by labels are sent to every task.
MOST_LABELS = 1_000


def labels_of(df: DataFrame, label: str) -> list:
    """The distinct labels in order; more than MOST_LABELS raise ValueError."""
    found = [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    return sorted(found)


def _followed(df: DataFrame, label: str, time: str, groups: list[str]) -> DataFrame:
    """(from, to): each label and the one after it, null for a group's last.

    Without groups all rows are one sequence: times are dealt out by range, and the last row of a range is followed by the first of the next range that has rows."""
    if groups:
        return df.select(F.col(label).alias("from"), F.lead(label).over(Window.partitionBy(*groups).orderBy(time)).alias("to"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written down, as a range's number must not change any more.
    dealt = written(df.select(F.col(label).alias("from"), F.col(time).alias("_time")).repartitionByRange(n, "_time").withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range").orderBy("_time")
    placed = dealt.withColumn("to", F.lead("from").over(own)).withColumn("_last", F.lead(F.lit(True)).over(own).isNull()).withColumn("_first", F.lag(F.lit(True)).over(own).isNull())
    edges = placed.filter("_first").select("_range", F.lead("from").over(Window.orderBy("_range")).alias("_next"))  # a row for each of n ranges
    return placed.join(F.broadcast(edges), "_range").select("from", F.when(F.col("_last"), F.col("_next")).otherwise(F.col("to")).alias("to"))


def transition(df: DataFrame, label: str, time: str, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """(from, to, p): how often a label follows another within a group, as a share of what follows; pairs of labels that don't occur have 0. More than MOST_LABELS raise ValueError."""
    labels_of(df, label)
    pairs = _followed(df, label, time, groups).filter("`to` IS NOT NULL").groupBy("from", "to").agg(F.count("*").alias("n"))
    names = df.select(F.col(label).alias("from")).filter("`from` IS NOT NULL").distinct()
    sums = pairs.groupBy("from").agg(F.sum("n").alias("all"))
    # labels x labels: a handful
    grid = names.join(sums, "from", "left").crossJoin(F.broadcast(names.withColumnRenamed("from", "to")))
    return grid.join(pairs, ["from", "to"], "left").select("from", "to", F.try_divide(F.coalesce("n", F.lit(0)), F.col("all")).alias("p"))


def emission(df: DataFrame, true: str, predicted: str | list[str]) -> DataFrame:
    """(label, predicted, p): how often each label is predicted where `true` is so; or (label, p0, p1 ...) for columns of probabilities."""
    if isinstance(predicted, list):
        return df.groupBy(F.col(true).alias("label")).agg(*[F.avg(p).alias(f"p{i}") for i, p in enumerate(predicted)])
    labels_of(df, true)
    counts = df.groupBy(F.col(true).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    sums = counts.groupBy("label").agg(F.sum("n").alias("all"))
    grid = sums.crossJoin(F.broadcast(sums.select(F.col("label").alias("predicted"))))
    return grid.join(counts, ["label", "predicted"], "left").select("label", "predicted", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("p"))


def prior(df: DataFrame, true: str, uniform: bool = True) -> DataFrame:
    """(label, p): equal shares, or observed ones."""
    counts = df.groupBy(F.col(true).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    p = 1 / F.col("k") if uniform else F.col("n") / F.col("all")
    return counts.crossJoin(F.broadcast(total)).select("label", p.alias("p"))


def group_lengths(df: DataFrame, group: str, position: str) -> DataFrame:
    """(group, n, first): sizes of groups, to be ordered by `first`, their first appearance."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.min(position).alias("first"))


def decode(obs: np.ndarray, start: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Most likely states of a sequence of observed states; of equals the lower one."""
    if not len(obs):
        return np.empty(0, int)
    e, t = np.log(emit + TINY), np.log(trans + TINY)
    score = np.empty((len(obs), len(start)))
    score[0] = np.log(start + TINY) + e[:, obs[0]]
    for j in range(1, len(obs)):
        score[j] = (score[j - 1][:, None] + t).max(0) + e[:, obs[j]]
    path = np.empty(len(obs), int)
    path[-1] = score[-1].argmax()
    for j in range(len(obs) - 2, -1, -1):
        path[j] = (t[:, path[j + 1]] + score[j]).argmax()
    return path


def _posterior(obs: np.ndarray, start: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(state probabilities, expected transitions, log likelihood) of one sequence, by scaled forward and backward passes."""
    n, k = len(obs), len(start)
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for j in range(n):
        alpha[j] = (start if j == 0 else alpha[j - 1] @ trans) * emit[:, obs[j]]
        scale[j] = max(alpha[j].sum(), 1e-300)
        alpha[j] /= scale[j]
    for j in range(n - 2, -1, -1):
        beta[j] = trans @ (emit[:, obs[j + 1]] * beta[j + 1]) / scale[j + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    if n > 1:
        ahead = emit[:, obs[1:]].T * beta[1:] / scale[1:, None]
        moves = trans * (alpha[:-1].T @ ahead)
    else:
        moves = np.zeros_like(trans)
    return gamma, moves, float(np.log(scale).sum())


def refit(seqs: list[np.ndarray], k: int, ste: str = "st", start=None, emit=None, trans=None, n_iter: int = 100, n_trials: int = 100, seed: int = 123, tol: float = 1e-2) -> tuple[tuple, float]:
    """((start, emission, transition), log likelihood): the best of several random starts of expectation maximisation. What ste names (s, t, e) is fitted; given rows are concentrations of the starts."""
    rng = np.random.default_rng(seed)
    best: tuple | None = None
    norm = lambda x: x / x.sum(-1, keepdims=True)

    def draw(given, rows):
        a = rng.random((rows, k)) + 1e-3 if given is None else np.array([rng.dirichlet(np.maximum(r, 1e-3)) for r in np.atleast_2d(given)])
        return norm(a)

    for _ in range(n_trials + 1):
        fresh = n_trials > 0
        s = draw(start, 1)[0] if fresh and "s" in ste else np.asarray(start, float)
        t = draw(trans, k) if fresh and "t" in ste else np.asarray(trans, float)
        e = draw(emit, k) if fresh and "e" in ste else np.asarray(emit, float)
        was = -np.inf
        for _ in range(n_iter):
            got = [_posterior(o, s, e, t) for o in seqs if len(o)]
            score = sum(g[2] for g in got)
            if "s" in ste:
                s = norm(sum(g[0][0] for g in got) + 1e-12)
            if "t" in ste:
                t = norm(sum(g[1] for g in got) + 1e-12)
            if "e" in ste:
                e = norm(np.stack([sum((g[0] * (o == j)[:, None]).sum(0) for g, o in zip(got, [o for o in seqs if len(o)], strict=True)) for j in range(k)], 1) + 1e-12)
            if score - was < tol:
                break
            was = score
        score = sum(_posterior(o, s, e, t)[2] for o in seqs if len(o))
        if best is None or score > best[1]:
            best = ((s, e, t), score)
        if not fresh:
            break
    return best


@dataclass
class Smoother:
    """Smooths predicted labels. Parameters not given are learned by fit(); with n_components they are fitted anew to each group's predictions instead."""

    labels: list = field(default_factory=list)
    startprob: np.ndarray | None = None
    emissionprob: np.ndarray | None = None
    transmat: np.ndarray | None = None
    n_components: int | None = None
    ste: str = "st"
    n_iter: int = 100
    n_trials: int = 100
    random_state: int = 123

    def fit(self, df: DataFrame, predicted: str | list[str], true: str, time: str, groups: list[str] = []) -> Smoother:  # noqa: B006
        self.labels = labels_of(df, true)
        at = {x: i for i, x in enumerate(self.labels)}
        k = len(at)
        if self.n_components is not None and self.n_components != k:
            raise ValueError(f"{self.n_components} components for {k} labels")
        if self.startprob is None:
            self.startprob = np.full(k, 1 / k)
        if self.emissionprob is None:
            self.emissionprob = np.zeros((k, k))
            for r in emission(df.filter(F.col(true).isNotNull()), true, predicted).collect():
                if isinstance(predicted, list):
                    self.emissionprob[at[r.label]] = [r[f"p{i}"] for i in range(k)]
                elif r.predicted in at:
                    self.emissionprob[at[r.label], at[r.predicted]] = r.p
        if self.transmat is None:
            self.transmat = np.zeros((k, k))
            for r in transition(df, true, time, groups).collect():
                self.transmat[at[r["from"]], at[r["to"]]] = r.p if r.p is not None else 1 / k
        return self

    def _run(self, df: DataFrame, predicted: str, time: str, groups: list[str], out: str, proba: bool) -> DataFrame:
        me = self
        kind = "array<double>" if proba else df.schema[predicted].dataType.simpleString()

        def smooth(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(time, ignore_index=True)
            # Missing predictions stay missing and don't interrupt the chain.
            known = part[predicted].notna()
            obs = np.searchsorted(np.asarray(me.labels), part.loc[known, predicted].to_numpy())
            par = (np.asarray(me.startprob), np.asarray(me.emissionprob), np.asarray(me.transmat))
            if me.n_components is not None and len(obs):
                par, _ = refit([obs], me.n_components, me.ste, *par, n_iter=me.n_iter, n_trials=me.n_trials, seed=me.random_state)
            found = pd.Series([None] * len(part), dtype=object)
            if len(obs):
                if proba:
                    found[known.to_numpy()] = pd.Series(_posterior(obs, *par)[0].tolist(), index=np.flatnonzero(known))
                else:
                    found[known.to_numpy()] = np.asarray(me.labels, dtype=object)[decode(obs, *par)]
            return part.assign(**{out: found})

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
        return df.drop(out).groupBy(*groups).applyInPandas(smooth, f"{kinds}, {out} {kind}")

    def predict(self, df: DataFrame, predicted: str, time: str, groups: list[str], out: str = "smoothed") -> DataFrame:
        """df with the most likely label of every row, group by group."""
        return self._run(df, predicted, time, groups, out, False)

    def predict_proba(self, df: DataFrame, predicted: str, time: str, groups: list[str], out: str = "probability") -> DataFrame:
        """df with the probability of each label; only where parameters are fitted to each group."""
        if self.n_components is None:
            raise NotImplementedError("probabilities need parameters fitted to each group")
        return self._run(df, predicted, time, groups, out, True)
