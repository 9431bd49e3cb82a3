"""Queries over the signal kernels; a signal is an embedding's 64 values."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions import dsp
from strideway.functions import features as K
from strideway.plans.queries import query, r, vectors

#: Samples a second.
RATE = 10
LAGS = 24


def kernel(spark: SparkSession, sf: str, f, names: list[str], digits: int = 6) -> DataFrame:
    out = vectors(spark, sf).select("vec_id", K.per_window(f, names, F.col("v")).alias("f"))
    return out.select("vec_id", *[r(f"f.{n}", digits).alias(n) for n in names])


@query
def feature_moments(spark, sf):
    return kernel(spark, sf, K.moments, ["avg", "std", "skew", "kurt"], 4)


@query
def feature_quantiles(spark, sf):
    return kernel(spark, sf, K.quantiles, ["min", "q25", "med", "q75", "max"])


@query
def feature_acf(spark, sf):
    """Autocorrelations at all lags up to LAGS."""
    names = [f"acf{k}" for k in range(LAGS + 1)]
    return kernel(spark, sf, lambda v: dict(zip(names, dsp.autocorrelation(v, LAGS), strict=True)), names)


@query
def feature_acf_peaks(spark, sf):
    return kernel(spark, sf, partial(K.autocorrelations, rate=RATE), ["acf_1st_max", "acf_1st_max_loc", "acf_1st_min", "acf_1st_min_loc", "acf_zeros"])


@query
def feature_spectrum(spark, sf):
    return kernel(spark, sf, partial(K.spectrum, rate=RATE), ["pentropy", "power", "f1", "f2", "f3", "p1", "p2", "p3"])


@query
def feature_bands(spark, sf):
    return kernel(spark, sf, partial(K.bands, rate=16), [f"fft{i}" for i in range(6)])


@query
def peaks_found(spark, sf):
    """How many peaks stand out by 0.3 or more, where the first and last are, and how much they stand out."""

    def found(v):
        at, stand = dsp.find_peaks(v, prominence=0.3)
        return {"n": len(at)} | ({"first": at[0], "last": at[-1], "total": stand.sum()} if len(at) else {})

    return kernel(spark, sf, found, ["n", "first", "last", "total"])


@query
def peaks_apart(spark, sf):
    """Peaks at least five places apart: a lower one near a higher one goes."""

    def found(v):
        at, _ = dsp.find_peaks(v, distance=5)
        return {"n": len(at), "places": at.sum()}

    return kernel(spark, sf, found, ["n", "places"])


@query
def signal_filtered(spark, sf):
    """Low-passed forward and backward."""
    names = [f"v{i}" for i in range(0, 64, 7)]
    return kernel(spark, sf, lambda v: dict(zip(names, dsp.butterfilt(v, 3, RATE)[::7], strict=True)), names)


def axes(spark, sf) -> DataFrame:
    return vectors(spark, sf).select("vec_id", F.transform("v", lambda a: a * 4).alias("x"), F.transform("v", lambda a: a / 2).alias("y"), F.transform("v", lambda a: a * 0 + 1).alias("z"))


@query
def magnitude_steps(spark, sf):
    """The norm of three axes less one, cut at 2, low-passed, and the peaks in it as seconds."""
    w = axes(spark, sf)
    out = w.select("vec_id", K.step_peaks(F.col("x"), F.col("y"), F.col("z"), RATE, 0.1, 0.2, 3).alias("t"))
    return out.select("vec_id", F.size("t").alias("steps"), r(F.aggregate("t", F.lit(0.0), lambda a, b: a + b)).alias("total"), r(F.try_element_at("t", F.lit(1))).alias("first"))


@query
def features_gate(spark, sf):
    """Windows of two seconds or less, or with a value missing, have no features."""
    w = axes(spark, sf).withColumn("x", F.slice("x", 1, F.lit(1) + (F.col("vec_id") % 40).cast("int")))
    n = F.size("x")
    w = w.withColumns({"y": F.slice("y", 1, n), "z": F.slice("z", 1, n)}).withColumn("x", F.when(F.col("vec_id") % 7 != 0, F.col("x")).otherwise(F.transform("x", lambda v, i: F.when(i != 3, v))))
    out = w.select("vec_id", F.size("x").alias("n"), K.features_of(F.col("x"), F.col("y"), F.col("z"), RATE).alias("f"))
    return out.select("vec_id", "n", F.col("f.avg").isNotNull().alias("has"), r("f.avg", 6).alias("avg"), r("f.max", 6).alias("max"))
