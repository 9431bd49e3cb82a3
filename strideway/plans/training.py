"""Training windows and what is done to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.operators.clean import XYZ
from strideway.operators.grid import at_micros, field_of, micros, with_first


def training_windows(df: DataFrame, seconds: float, length: int, steptol: int = 3) -> DataFrame:
    """(pid, window_start, n, x, y, z, steps, walk): windows anchored at midnight; short ones are left out, longer ones cut. Steps of windows that aren't walks are 0."""
    us = int(seconds * 1e6)
    midnight = F.floor(F.col("_from") / 86_400_000_000) * 86_400_000_000
    rows = with_first(df, ["pid"]).withColumn("w", midnight + F.floor((micros("time") - midnight) / us) * us)
    got = rows.groupBy("pid", "w").agg(F.count("*").alias("n"), F.sum("annotation").alias("steps"), F.sort_array(F.collect_list(F.struct("time", *XYZ))).alias("rows")).filter(F.col("n") >= length)
    walk = (F.col("steps") >= steptol).cast("int")
    return got.select("pid", at_micros(F.col("w")).alias("window_start"), "n", *[field_of(F.slice("rows", 1, length), a).alias(a) for a in XYZ], F.when(walk == 1, F.col("steps")).otherwise(0).alias("steps"), walk.alias("walk"))


def good(first: Column, last: Column, n: Column, values: list[Column], length: int, seconds: float) -> Column:
    """No value missing, as many samples as wanted, and a duration within a hundredth."""
    whole = F.lit(True)
    for v in values:
        whole = whole & ~F.exists(v, lambda x: x.isNull())
    took = (micros(last) - micros(first)) / 1e6
    return whole & (n == length) & (F.abs(took - seconds) < 0.01 * seconds)


def kept(windows: DataFrame, length: int, seconds: float) -> DataFrame:
    """The windows that are good() to train on. windows: (first, last, n, x, y, z)."""
    return windows.filter(good(F.col("first"), F.col("last"), F.col("n"), [F.col(a) for a in XYZ], length, seconds))


def write_training(windows: DataFrame, path: str) -> None:
    """Training windows as Parquet, arrays of axes and their labels in one row."""
    windows.write.mode("overwrite").parquet(path)


def read_training_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def examples(df: DataFrame, n_walk: int = 10, n_other: int = 5) -> DataFrame:
    """The first windows of each class, as a plot of examples shows them."""
    first = lambda class_, n: df.filter(class_).orderBy("pid", "window_start").limit(n)  # noqa: E731  each task keeps n at most
    return first(F.col("walk") == 1, n_walk).unionByName(first(F.col("walk") != 1, n_other))


def encoded(c: Column, labels: list) -> Column:
    """Position of a label among the labels, from 0; NULL for another."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), c)
    return F.when(at > 0, (at - 1).cast("int"))


def decoded(c: Column, labels: list) -> Column:
    """The label at a position from 0; NULL beyond the labels."""
    return F.when((c >= 0) & (c < len(labels)), F.element_at(F.array(*[F.lit(x) for x in labels]), c.cast("int") + 1))


class EarlyStopping:
    """Tells a training loop when its loss has not gained for `patience` rounds; keep() is called with every best state."""

    def __init__(self, patience: int = 5, least_gain: float = 0.0, keep=None):
        self.patience, self.least_gain, self.keep = patience, least_gain, keep
        self.best, self.waited, self.stop = float("inf"), 0, False

    def __call__(self, loss: float, state=None) -> bool:
        if loss < self.best - self.least_gain:
            self.best, self.waited = loss, 0
            if self.keep:
                self.keep(state)
        else:
            self.waited += 1
            self.stop = self.waited >= self.patience
        return self.stop


def resized(df: DataFrame, column: str, length: int) -> DataFrame:
    """Arrays of a column by linear interpolation at `length` even places from the first to the last value."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        grid = np.linspace(0, 1, length)
        return pd.Series([None if x is None or not len(x) else np.interp(grid, np.linspace(0, 1, len(x)), np.asarray(x, float)).tolist() for x in v], dtype=object)

    return df.withColumn(column, run(F.col(column)))


def augmented(df: DataFrame, seed: int, columns: list[str] = XYZ, most: int = 3) -> DataFrame:
    """Windows with their axes permuted, turned by a random rotation, and thinned out by a random whole factor. Seeded by row, so runs agree."""
    schema = df.schema

    def run(batches):
        for part in batches:
            for i in part.index:
                rng = np.random.default_rng([seed, *np.frombuffer(np.asarray(part.at[i, columns[0]], float)[:1].tobytes(), np.uint32).tolist()])
                w = np.stack([np.asarray(part.at[i, c], float) for c in columns], 1)[:, rng.permutation(len(columns))]
                axis = rng.normal(size=3)
                axis /= np.linalg.norm(axis)
                angle = rng.uniform(-np.pi, np.pi)
                k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
                w = w @ (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k).T
                step = int(rng.integers(1, most + 1))
                thin = w[::step]
                w = np.stack([np.interp(np.linspace(0, 1, len(w)), np.linspace(0, 1, len(thin)), thin[:, j]) for j in range(3)], 1)
                for j, c in enumerate(columns):
                    part.at[i, c] = w[:, j].tolist()
            yield part

    return df.mapInPandas(run, schema)
